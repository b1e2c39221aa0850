"""Queries of the package checks: suppliers stand for packages with a manifest, documents for their scripts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import checks
from plumbline.plans.bindings import Registry, table
from plumbline.sources import manifests

R = Registry()

#: Scopes and allowlists that the suppliers' manifests declare, by the remainder of the key.
WRITES = ["[]", '["SOUL.md"]', '["**"]', '["out/a.txt"]', '["/etc/rc.local"]']
DENIES = ["[]", '["SOUL.md", "MEMORY.md", "AGENTS.md"]', '["out/a.txt", "**"]']
ALLOWS = ["[]", '["a.example.com"]', '["*"]', '["*.com"]']


def _packages(spark, d) -> DataFrame:
    k = F.col("s_suppkey")
    pick = lambda these: F.get(F.array(*map(F.lit, these)), (k % len(these)).cast("int"))
    perms = F.concat(
        F.lit('{"files": {"write": '), pick(WRITES), F.lit(', "deny_write": '), pick(DENIES), F.lit('}, "shell": '), (k % 2 == 0).cast("string"),
        F.lit(', "network": {"allow": '), pick(ALLOWS), F.lit("}}"),
    )
    j = F.concat(
        F.lit('{"risk_tier": "L'), (k % 4).cast("string"), F.lit('"'), F.when(k % 6 == 0, ', "content_hash": "sha256:00"').otherwise(""),
        F.when(k % 7 == 0, "").otherwise(F.concat(F.lit(', "permissions": '), perms)), F.lit("}"),
    )
    return manifests.declared(table(spark, d, "supplier").select(k.cast("string").alias("pkg_id"), F.parse_json(j).alias("manifest")))


_FIRED = [
    ("AST01-content-hash-missing", "k % 6 <> 0"),
    ("AST03-identity-file-write-grant", "p AND w IN (1, 2) AND d = 0"),
    ("AST03-unbounded-write-scope", "NOT p"),
    ("AST03-shell-network-privilege-combo", "p AND k % 4 = 2"),
    ("AST03-wildcard-network-egress", "p AND k % 4 IN (2, 3)"),
    ("AST04-risk-tier-spoofing", "p AND k % 4 < CASE WHEN (w = 1 AND d <> 1) OR (k % 2 = 0 AND live) THEN 3 WHEN k % 2 = 0 THEN 2 WHEN live OR k % 4 <> 0 THEN 1 ELSE 0 END"),
    ("AST05-wildcard-domain-allowlist", "p AND k % 4 IN (2, 3)"),
    ("AST06-root-write-scope", "p AND ((w = 2 AND d <> 2) OR w = 4)"),
    ("AST06-unrestricted-shell-exec", "p AND k % 2 = 0"),
    ("AST06-unscoped-shared-state-write", "p AND w = 1 AND d <> 1"),
    ("AST06-missing-sandbox-declaration", "NOT p"),
]
_KEYS_SQL = (
    "WITH s AS (SELECT s_suppkey AS k, s_suppkey % 7 <> 0 AS p, s_suppkey % 5 AS w, s_suppkey % 3 AS d FROM supplier), "
    "x AS (SELECT *, (w = 1 AND d <> 1) OR (w IN (2, 3) AND d <> 2) OR w = 4 AS live FROM s) "
)


@R.query(_KEYS_SQL + " UNION ALL ".join(f"SELECT k::VARCHAR AS pkg_id, '{c}' AS check_id FROM x WHERE {cond}" for c, cond in _FIRED))
def declared_checks(spark, d):
    """The checks of declared permissions that fire, for every package."""
    return checks.declared_findings(_packages(spark, d)).where("detected").select("pkg_id", "check_id")


def _scripts(spark, d) -> DataFrame:
    i = F.col("doc_id")
    tail = F.concat(
        F.when(i % 11 == 0, "\ny = yaml.load(x)\n").otherwise(""), F.when(i % 13 == 0, F.concat(F.lit("\nrequests.get('https://h"), i % 3, F.lit(".example.com/')\n"))).otherwise(""),
        F.when(i % 17 == 0, "​").otherwise(""),
    )
    path = F.concat(F.lit("scripts/"), F.lpad(i.cast("string"), 8, "0"), F.lit(".py"))
    return table(spark, d, "documents").select(F.col("source").alias("pkg_id"), path.alias("path"), F.concat("text", tail).alias("text"))


_TEXT_SQL = (
    "WITH f AS (SELECT source AS pkg_id, doc_id AS i, 'scripts/' || lpad(doc_id::VARCHAR, 8, '0') || '.py' AS path FROM documents), h AS ("
    "SELECT pkg_id, 'AST04-yaml-injection' AS check_id, path || ': yaml.load() without a safe loader' AS e FROM f WHERE i % 11 = 0 UNION ALL "
    "SELECT pkg_id, 'AST04-permission-understating', path || ': egress call to undeclared host(s) [h' || i % 3 || '.example.com]' FROM f WHERE i % 13 = 0 AND i % 3 <> 0 UNION ALL "
    "SELECT pkg_id, 'AST04-invisible-unicode-smuggling', path || ': [U+200B]' FROM f WHERE i % 17 = 0) SELECT pkg_id, check_id, min(e) AS evidence FROM h GROUP BY 1, 2"
)


@R.query(_TEXT_SQL)
def text_checks(spark, d):
    """The checks of file text that fire, with the first hit of each package as evidence."""
    files = _scripts(spark, d)
    perms = F.parse_json(F.lit('{"permissions": {"files": {"deny_write": []}, "network": {"allow": ["h0.example.com"]}}}'))
    packages = manifests.declared(files.select("pkg_id").distinct().select("pkg_id", perms.alias("manifest")))
    return checks.text_findings(packages, files).where("detected").select("pkg_id", "check_id", "evidence")
