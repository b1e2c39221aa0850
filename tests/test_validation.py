"""Validation of manifests: each case changes one thing in a manifest that is in order."""

import copy
import json

from pyspark.sql import functions as F

from plumbline.operators import validation

GOOD = {
    "name": "x", "version": "1.0.0", "platforms": ["a"], "description": "d", "author": {"name": "n", "identity": "did:web:example.com", "signing_key": "k"},
    "permissions": {"files": {"read": ["./SKILL.md"], "write": [], "deny_write": ["SOUL.md", "MEMORY.md", "AGENTS.md"]}, "network": {"allow": [], "deny": "*"}, "shell": False, "tools": ["read_file"]},
    "risk_tier": "L0", "scan_status": {"scanner": "none", "result": "unscanned"}, "signature": "unsigned", "content_hash": "sha256:" + "0" * 64,
    "changelog": [{"version": "1.0.0"}],
}
GONE = object()
CASES = {
    "good": ({}, []),
    "signed": ({"signature": "ed25519:" + "a" * 128}, []),
    # shape; nothing else is told then
    "no name": ({"name": GONE, "risk_tier": "L9"}, [("error", "required", "$.name")]),
    "shell text": ({"permissions.shell": "yes"}, [("error", "type", "$.permissions.shell")]),
    "no files": ({"permissions.files": GONE}, [("error", "required", "$.permissions.files")]),
    "number in list": ({"permissions.files.write": [1, "a"]}, [("error", "type", "$.permissions.files.write[0]")]),
    "hash": ({"content_hash": "sha256:0"}, [("error", "pattern", "$.content_hash")]),
    "null tier": ({"risk_tier": None}, [("error", "type", "$.risk_tier")]),
    # meaning
    "glob": ({"permissions.files.read": ["a/*.md", "b/../c*"]}, [("error", "explicit-path", "$.permissions.files.read[0]"), ("error", "explicit-path", "$.permissions.files.read[1]"), ("error", "parent-path", "$.permissions.files.read[1]")]),
    "identity open": ({"permissions.files.deny_write": ["SOUL.md", "d/MEMORY.md"]}, [("error", "identity-default", "$.permissions.files.deny_write")]),
    "inert": ({"permissions.files.write": ["./SOUL.md"], "risk_tier": "L0"}, [("warning", "inert-grant", "$.permissions.files")]),
    "granted": ({"permissions.files.deny_write": ["MEMORY.md", "AGENTS.md"], "permissions.files.write": ["SOUL.md"], "risk_tier": "L3"}, []),
    "hosts": ({"permissions.network.allow": ["a.example.com", "*.b", "http://c", "d/e", "f:1", "G.h", "-i"], "risk_tier": "L1"}, [("error", "host", f"$.permissions.network.allow[{i}]") for i in range(1, 7)]),
    "deny list": ({"permissions.network.deny": ["a"]}, [("error", "network-deny", "$.permissions.network.deny")]),
    "no deny": ({"permissions.network.deny": GONE}, [("warning", "network-deny", "$.permissions.network.deny")]),
    "idle tools": ({"permissions.tools": ["curl", "http"]}, [("warning", "idle-tools", "$.permissions.tools")]),
    "low tier": ({"permissions.shell": True, "risk_tier": "L1"}, [("error", "risk-tier", "$.risk_tier")]),
    "high tier": ({"risk_tier": "L2"}, [("warning", "risk-tier", "$.risk_tier")]),
    "odd tier": ({"risk_tier": "L7"}, [("error", "risk-tier", "$.risk_tier")]),
    "shadowed write": ({"permissions.files.write": ["a/x.txt"], "permissions.files.deny_write": ["SOUL.md", "MEMORY.md", "AGENTS.md", "x.txt"]}, []),
    "signature": ({"signature": "ed25519:" + "A" * 128}, [("error", "signature", "$.signature")]),
    "no key": ({"signature": "ed25519:" + "a" * 128, "author.signing_key": GONE}, [("error", "signing-key", "$.author.signing_key")]),
    "no identity": ({"author.identity": ""}, [("warning", "identity", "$.author.identity")]),
    "no scan": ({"scan_status": GONE}, [("warning", "scan-status", "$.scan_status")]),
    "unscanned by": ({"scan_status.scanner": "s"}, [("error", "scan-status", "$.scan_status")]),
    "scanned by none": ({"scan_status.result": "clean"}, [("error", "scan-status", "$.scan_status")]),
    "changelog": ({"version": "2.0.0"}, [("error", "changelog", "$.changelog")]),
    "empty changelog": ({"version": "2.0.0", "changelog": []}, []),
}


def changed(changes):
    m = copy.deepcopy(GOOD)
    for path, value in changes.items():
        *above, last = path.split(".")
        here = m
        for k in above:
            here = here[k]
        if value is GONE:
            del here[last]
        else:
            here[last] = value
    return m


def test_violations(spark):
    rows = [(n, json.dumps(changed(c))) for n, (c, _) in CASES.items()] + [("list", "[1]"), ("null", None)]
    df = spark.createDataFrame(rows, "pkg_id string, m string").select("pkg_id", F.parse_json("m").alias("manifest"))
    out = validation.validate(df).cache()
    got = {r.pkg_id: r for r in out.collect()}
    for name, (_, want) in CASES.items():
        assert [(v.severity, v.rule, v.path) for v in got[name].violations] == want, name
        assert got[name].ok == all(s == "warning" for s, *_ in want), name
    assert (got["good"].signature_state, got["signed"].signature_state, got["signature"].signature_state) == ("unsigned", "signed", "malformed")
    assert (got["good"].derived_risk_tier, got["granted"].derived_risk_tier, got["no name"].derived_risk_tier, got["shadowed write"].derived_risk_tier) == ("L0", "L3", None, "L0")
    assert got["glob"].violations[2].message == "b/../c* has a '..' segment, which leads out of its root"
    assert got["low tier"].violations[0].message == "L1 is below L2, which the permissions ask for"
    assert [v.rule for v in got["list"].violations] == ["shape"] and [v.rule for v in got["null"].violations] == ["shape"]
    assert validation.violations(out).count() == sum(len(r.violations) for r in got.values())


def test_manifests_are_held_against_the_package(spark):
    rows = [("same", GOOD["content_hash"], "x"), ("other", "sha256:1", "y"), ("unknown", None, None)]
    df = spark.createDataFrame([(n, json.dumps(GOOD), h, name) for n, h, name in rows], "pkg_id string, m string, actual_hash string, native_name string")
    got = {r.pkg_id: [v.rule for v in r.violations] for r in validation.validate(df.withColumn("manifest", F.parse_json("m"))).collect()}
    assert got == {"same": [], "other": ["content-hash", "name"], "unknown": []}
