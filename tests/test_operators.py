"""Operators of the engine against results that are written down, not worked out by a second query."""

from pyspark.sql import functions as F

from plumbline.functions import paths
from plumbline.functions import text as t
from plumbline.operators import evals, findings, panel, routing
from plumbline.plans.bindings import permission_rows

PERMISSIONS = "name string, w array<string>, d array<string>, shell boolean, allow array<string>"


def test_risk_tiers(spark):
    tier = paths.risk_tier(F.col("w"), F.col("d"), F.col("shell"), F.col("allow"))
    got = {r.name: r.tier for r in spark.createDataFrame(permission_rows(), PERMISSIONS).select("name", tier.alias("tier")).collect()}
    assert got == {
        "none": "L0", "reads": "L1", "named": "L3", "dotted": "L3", "denied": "L1", "glob": "L1", "stem": "L3", "deep": "L3", "all": "L0", "shell": "L2",
        "taken": "L2", "bare": "L0", "nested": "L3", "agents": "L3",
    }


FINDINGS = "pkg_id string, scenario string, evidence string, check_id string"
WAIVERS = "skill string, scenario string, evidence_contains string, reason string, ordinal int"


def test_waivers_keep_every_finding(spark):
    rows = [("p", "s", "a.md: x", "c1"), ("p", "s", "a.md: x", "c2"), ("p", "s", "a.md: x", "c2"), ("p", "s", "b.md: y", "c1"), ("q", "s", None, "c1")]
    waivers = [("p", "s", "a.md", "second", 2), ("p", "s", ": x", "first", 1), ("q", "s", "", "null evidence", 3), ("p", "t", "", "no finding", 4)]
    f, w = spark.createDataFrame(rows, FINDINGS), spark.createDataFrame(waivers, WAIVERS)
    got = sorted((r.pkg_id, r.check_id, r.evidence or "", r.waived, r.waiver_reason) for r in findings.apply_waivers(f, w).collect())
    assert got == [
        ("p", "c1", "a.md: x", True, "first"), ("p", "c1", "b.md: y", False, None), ("p", "c2", "a.md: x", True, "first"), ("p", "c2", "a.md: x", True, "first"),
        ("q", "c1", "", False, None),
    ]
    stale = findings.stale_waivers(f, w.unionByName(spark.createDataFrame([("q", "u", "z", "", 5)], WAIVERS)))
    assert {r.reason for r in stale.collect()} == {"null evidence", "no finding", ""}
    assert findings.apply_waivers(f, w.limit(0)).where("waived").count() == 0


def test_a_null_key_is_no_total(spark):
    df = spark.createDataFrame([("a", "x"), (None, "x"), (None, None)], "k string, v string")
    got = {(r.k, r.v): r.n for r in findings.rollup_counts(df, "k", "v").collect()}
    assert got == {("a", "x"): 1, (None, "x"): 1, (None, None): 1, ("a", "TOTAL"): 1, (None, "TOTAL"): 2, ("TOTAL", "TOTAL"): 3}


def test_sarif(spark):
    rows = [("p", "c", True, "full", "a b.md:3: x"), ("p", "c", True, "full", "d/a.md:3: x\u202e\r"), ("p", "c", True, None, ""), ("p", "c", False, "part", "a.md: x"), ("p", "c", True, "part", "e.md: y")]
    out = findings.sarif_results(spark.createDataFrame(rows, "pkg_id string, check_id string, detected boolean, covers string, evidence string"))
    assert sorted((r.kind, r.level, r.message, r.uri or "", r.start_line or 0) for r in out.collect()) == [
        ("fail", "error", "a b.md:3: x", "", 0), ("fail", "error", "d/a.md:3: x ", "d/a.md", 3), ("fail", "warning", "c detected", "", 0), ("fail", "warning", "e.md: y", "e.md", 0),
        ("pass", "none", "c: ran and cleared", "", 0),
    ]


def test_texts_say_what_was_cut(spark):
    df = spark.createDataFrame([("x" * 800,), ("x" * 805,), ("",), (None,)], "s string").select(t.excerpt(F.col("s")).alias("e"), t.sarif_text(F.col("s"), 3).alias("m"))
    got = [(r.e.excerpt, r.e.chars, r.m) for r in df.collect()]
    assert got == [("x" * 800, 800, "xxx… [truncated]"), ("x" * 800 + "… [truncated 5 more characters]", 805, "xxx… [truncated]"), ("", 0, ""), (None, None, None)]


def test_grounded_evidence(spark):
    body = "The Quick  brown\nfox jumps over the lazy dog"
    cases = {
        'it says "quick brown fox"': True, 'it says "quick"': False, "quick brown fox jumps OVER": True, "quick brown fox": False, "see a/b.md:2": True, "see outputs/a/b.md:2": True,
        "see a/b.md:3": False, "see a/b.md:0": False, "see c.md:1": False, "": False, "   ": False,
    }
    df = spark.createDataFrame([(e,) for e in cases], "e string")
    assert {r.e: r.ok for r in df.select("e", evals.grounded(F.col("e"), F.create_map(F.lit("a/b.md"), F.lit(body))).alias("ok")).collect()} == cases
    assert not any(r.ok for r in df.select(evals.grounded(F.col("e"), F.create_map(F.lit("a/b.md"), F.lit(" \n"))).alias("ok")).collect())


def test_mechanical_assertions(spark):
    outputs = {"a.json": '{"x": [1, 2]}', "b.txt": "one\r\ntwo\n", "c": ""}
    cases = {
        "Output file `a.json` exists.": True, "an output file named z.json exists": False, "The output file a.json parses as valid JSON": True, "output file b.txt is valid JSON": False,
        "output file z is valid json": False, "The output contains the text 'two'": True, "the output contains the string 'three'": False,
        "The output does not contain the literal `two`": False, "The output does not contain the literal `three`.": True, "output file b.txt has exactly 2 lines": True,
        "output file c has exactly 0 lines": True, "output file b.txt has exactly 3 lines": False, "output file z has exactly 0 lines": False,
        "The output contains the text 'two' and says why": None, "The output is good": None, "": None,
    }
    files = F.create_map(*(F.lit(x) for kv in outputs.items() for x in kv))
    df = spark.createDataFrame([(a,) for a in cases], "a string")
    assert {r.a: r.ok for r in df.select("a", evals.run_mechanical(evals.mechanical(F.col("a")), files).alias("ok")).collect()} == cases


def test_judge_verdicts(spark):
    rows = [("one skill", 1, None, 9, 0.0, 0.0), ("flat", 5, 0.5, 9, 1.0, 1.0), ("few", 5, 3.0, 3, 0.0, 0.0), ("round", 5, 3.0, 9, 0.6, 0.0), ("full", 5, 3.0, 9, 0.0, 0.5), ("good", 2, 1.0, 4, 0.59, 0.49)]
    q = spark.createDataFrame(rows, "provider string, skills long, skill_sd double, distinct_values long, multiple_rate double, full_rate double")
    got = {r.provider: r.verdict for r in panel.judge_verdict(q).collect()}
    assert got == {"one skill": "INSUFFICIENT-DATA", "flat": "NON-DISCRIMINATING", "few": "NON-DISCRIMINATING", "round": "COARSE", "full": "COARSE", "good": "DISCRIMINATING"}


def test_routes(spark):
    texts = ["A Trojan with a missing signature", "the scanner has write access", "bad", None, "evasion and encoded payload"]
    out = routing.route(spark.createDataFrame(list(enumerate(texts)), "i int, text string")).orderBy("i").collect()
    assert [(r.ast_id, r.contributing, r.escalate) for r in out] == [("AST01", ["AST02"], False), ("AST08", ["AST03"], False), (None, [], True), (None, [], True), (None, [], True)]
