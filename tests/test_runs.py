"""Trees of evaluation runs and the refusal ledger against results that are written down."""

import json
import random
import re
import statistics

import pytest
from pyspark.sql import functions as F

from plumbline.operators import ledger
from plumbline.sources import runs, scorecards

FILES = {
    "iteration-1/case-a/with_skill/grading.json": {"summary": {"pass_rate": 1.0}, "assertion_results": [{"text": "t", "passed": True, "evidence": "e", "mechanism": "script"}, {"text": "u", "passed": False}], "models": {"grader": "g"}},
    "iteration-1/case-a/with_skill/timing.json": {"duration_ms": 1500, "total_tokens": 10, "agent_model": "a"},
    "iteration-1/case-a/with_skill/run.json": {"configuration": "with_skill", "models": {"agent": "a"}},
    "iteration-1/case-a/with_skill/outputs/x/y.txt": "text",
    "iteration-1/case-a/with_skill-2/grading.json": {"summary": {"pass_rate": 0.5}},
    "iteration-1/case-a/without_skill/grading.json": {"summary": {"pass_rate": 0.25}, "models": {"agent": "m", "grader": " m "}},
    "iteration-1/case-b/with_skill/grading.json": {"summary": {"pass_rate": 0.0}},
    "iteration-1/case-b/without_skill/timing.json": {"duration_ms": None},
    "iteration-1/notes/readme.md": "none",
    "iteration-10/x-control-1/with_skill_3/grading.json": {"summary": {"pass_rate": 1.0}},
    "iteration-10/x-control-1/without_skill/grading.json": {"summary": {"pass_rate": 0.0}},
    "iteration-10/x-control-1/without_skill/run.json": {"configuration": "with_skill"},
    "iteration-2/case-c/with_skill/grading.json": "{",
    "iteration-2/case-c/other_arm/grading.json": {},
}


@pytest.fixture(scope="module")
def tree(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("workspace")
    for path, body in FILES.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(body if isinstance(body, str) else json.dumps(body))
    return runs.read_tree(spark, str(root)).cache()


def test_runs_are_typed_and_gaps_stay_gaps(tree):
    got = {(r.iteration, r.slug, r.arm, r.repeat): r for r in runs.runs(tree).collect()}
    assert len(got) == 8
    a = got[1, "case-a", "with_skill", 1]
    assert (a.outputs, a.graded, a.pass_rate, a.seconds, a.tokens, a.agent, a.grader, a.problem) == (1, True, 1.0, 1.5, 10.0, "a", "g", None)
    assert got[1, "case-a", "with_skill", 2].pass_rate == 0.5 and got[10, "x-control-1", "with_skill", 3].graded
    bare = got[1, "case-b", "without_skill", 1]
    assert (bare.graded, bare.pass_rate, bare.seconds) == (False, None, None)
    assert got[1, "case-a", "without_skill", 1].problem == "m graded itself"
    assert got[10, "x-control-1", "without_skill", 1].problem == "run.json says with_skill"
    assert (got[2, "case-c", "with_skill", 1].problem, got[2, "case-c", "with_skill", 1].graded) == ("not valid JSON: grading.json", False)
    rows = {(r.slug, r.repeat, r.idx): (r.text, r.passed, r.evidence, r.mechanism) for r in runs.assertions(tree).collect()}
    assert rows == {("case-a", 1, 0): ("t", True, "e", "script"), ("case-a", 1, 1): ("u", False, None, None)}
    assert {r.iteration for r in runs.latest(runs.runs(tree)).collect()} == {10}


def test_pairs_and_summary(tree):
    found = runs.runs(tree)
    got = {(r.iteration, r.slug): (r.with_rate, r.without_rate, r.missing, r.delta) for r in runs.pairs(found).collect()}
    assert got == {
        (1, "case-a"): (0.75, 0.25, [], 0.5), (1, "case-b"): (0.0, None, ["without_skill"], None), (10, "x-control-1"): (1.0, 0.0, [], 1.0),
        (2, "case-c"): (None, None, ["with_skill", "without_skill"], None),
    }
    summed = {(r.iteration, r.arm): r for r in runs.summary(found).collect()}
    a = summed[1, "with_skill"]
    assert (a.runs, a.pass_rate_mean, round(a.pass_rate_sd, 6), a.seconds_n, a.seconds_mean, a.paired, a.excluded) == (2, 0.75, 0.353553, 1, 1.5, 1, 1)
    assert summed[1, "without_skill"].pass_rate_sd is None and set(summed) == {(1, "with_skill"), (1, "without_skill"), (10, "with_skill"), (10, "without_skill")}
    assert {(r.iteration, r.delta_pass_rate, r.delta_seconds) for r in runs.deltas(runs.summary(found)).collect()} == {(1, 0.5, None), (10, 1.0, None)}
    assert {r.iteration for r in runs.summary(found, control=True).collect()} == {10}
    order = [(r.slug, r.arm, r.repeat) for r in runs.grading_order(found).where("iteration = 1").orderBy("place").collect()]
    assert len(order) == 5 and order == [(r.slug, r.arm, r.repeat) for r in runs.grading_order(found.repartition(3)).where("iteration = 1").orderBy("place").collect()]


def judged(*providers):
    return [{"provider": p, "total": 1} for p in providers]


PQR = {"rounds": 2, "providers": ["p", "q", "r"]}
REFUSAL = {"provider": "q", "skill": "s", "round": 2, "status": "failed", "reason": "timeout"}
CARDS = {
    ("old", "full"): PQR | {"skill": "s1", "judgments": judged(*"pqrpqr")},
    ("old", "short"): PQR | {"skill": "s2", "judgments": judged(*"pqrpr")},  # q of round 2
    ("old", "odd"): PQR | {"skill": "s3", "judgments": judged(*"prp")},  # two segments: q of both rounds, r of round 2
    ("old", "unsegmented"): PQR | {"skill": "s4", "judgments": judged(*"ppp")},  # three segments of two rounds
    ("old", "stranger"): PQR | {"skill": "s5", "judgments": judged(*"pqxpq")},
    ("old", "empty"): {"skill": "s6", "rounds": 0, "providers": [], "judgments": []},
    ("old", "over"): PQR | {"skill": "s7", "judgments": judged(*"pqrpqrp")},
    ("new", "told"): PQR | {"skill": "s", "attempted": 6, "judgments": judged(*"pqrpr"), "refusals": [REFUSAL]},
    ("new", "untold"): PQR | {"skill": "s", "attempted": 6, "judgments": judged(*"pqrpr")},
    ("new", "wrong"): PQR | {"skill": "s", "attempted": 6, "judgments": judged(*"pqrpr"), "refusals": [REFUSAL | {"provider": "r"}]},
    ("new", "few"): PQR | {"skill": "s", "attempted": 6, "judgments": judged(*"prpr"), "refusals": [REFUSAL]},
    ("new", "bad entry"): PQR | {"skill": "s", "attempted": 6, "judgments": judged(*"pqrpr"), "refusals": [REFUSAL | {"reason": " ", "status": "unavailable", "response_chars": 5}]},
    ("new", "no card"): {"skill": "s", "judgments": []},
}
LEDGER = """# Ledger
| Skill | Provider | Round | Why |
| --- | --- | ---: | --- |
| s2 | q | 2 | x |
| s3 | q | 1 | x |
| s3 | q | 2 | x |
| s9 | q | 1 | x |

| Corpus | Attempted | Pooled | Refused |
| --- | ---: | ---: | ---: |
| `old/` | 30 | 29 | 1 |
| total | n | n | n |

| Other | Provider | Round |
| --- | --- | --- |
| s8 | p | 1 |
"""


@pytest.fixture(scope="module")
def found(spark):
    rows = spark.createDataFrame([(c, f, json.dumps(body)) for (c, f), body in CARDS.items()], "corpus string, file string, text string")
    return ledger.cards(scorecards.parsed(rows).join(rows.select("corpus", "file"), "file")).cache()


def test_missing_attempts(found):
    got = {(r.file, r.provider, r.round) for r in ledger.missing(found).where("corpus = 'old'").collect()}
    assert got == {
        ("short", "q", 2), ("odd", "q", 1), ("odd", "q", 2), ("odd", "r", 2), ("unsegmented", "q", None), ("unsegmented", "r", None), ("stranger", "r", None),
    }
    loose = ledger.missing(found).where("file = 'unsegmented'").groupBy("provider").count().collect()
    assert {(r.provider, r["count"]) for r in loose} == {("q", 2), ("r", 2)}


def test_ledger_is_reconciled_both_ways(spark, found):
    texts = spark.createDataFrame([("l", LEDGER)], "doc string, text string")
    assert {tuple(r) for r in ledger.ledger_rows(texts).collect()} == {("s2", "q", 2), ("s3", "q", 1), ("s3", "q", 2), ("s9", "q", 1)}
    assert [tuple(r) for r in ledger.ledger_totals(texts).collect()] == [("old", 30, 29, 1)]
    got = {(r.corpus, r.file, r.kind, r.detail) for r in ledger.problems(found, texts).collect()}
    assert got == {
        ("old", "empty", "no-attempts", "neither rounds nor providers"), ("old", "over", "overfull", "7 of 6"),
        ("old", "odd", "unrecorded", "s3 r 2"), ("old", "unsegmented", "unrecorded", "s4 q ?"), ("old", "unsegmented", "unrecorded", "s4 r ?"), ("old", "stranger", "unrecorded", "s5 r ?"),
        ("old", None, "corpus-totals", "30/29/1 stated, 36/29/7 in the files"), (None, None, "phantom", "s9 q 1"),
        ("new", "untold", "no-refusals", "1 lost"), ("new", "wrong", "mismatch", "s q 2: 1 missing, 0 recorded"), ("new", "wrong", "mismatch", "s r 2: 0 missing, 1 recorded"),
        ("new", "few", "count", "2 lost, 1 recorded"), ("new", "few", "mismatch", "s q 1: 1 missing, 0 recorded"),
        ("new", "bad entry", "entry", "refusal 0 gives no reason"), ("new", "bad entry", "entry", "refusal 0 has the status unavailable"), ("new", "bad entry", "entry", "refusal 0 kept nothing of the response"),
    }
    report = ledger.report(found)
    assert {(r.corpus, r.attempted, r.pooled, r.refused) for r in report.where(F.col("skill").isNull()).collect()} == {("old", 36, 29, 7), ("new", 30, 24, 6)}


def test_runs_are_read_once_for_a_summary(spark):
    made = random.Random(2)
    rows = [(1 + i % 2, f"s{made.randrange(40)}", made.choice(runs.ARMS), i, made.random() < 0.7, made.choice([None, made.random()]), 0.1, None) for i in range(3000)]
    rows += [(1, "one-armed", runs.ARMS[0], i, True, 5.0, 7.0, 1.0) for i in range(9)] + [(3, "lone", a, 1, True, 0.5, None, 3.0) for a in runs.ARMS] + [(4, "none", runs.ARMS[0], 1, False, 0.5, None, 3.0)]
    found = spark.createDataFrame(rows, "iteration int, slug string, arm string, repeat int, graded boolean, pass_rate double, seconds double, tokens double").repartition(5)
    summed = runs.summary(found)
    assert summed._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1
    got = {(r.iteration, r.arm): r for r in summed.collect()}
    arms = {}
    for r in rows:
        arms.setdefault(r[:2], set()).update({r[2]} if r[4] else set())
    assert set(got) == {(i, a) for i in (1, 2, 3) for a in runs.ARMS}
    for (i, a), r in got.items():
        mine = [x for x in rows if x[0] == i and x[2] == a and x[4] and len(arms[x[:2]]) == 2]
        assert (r.runs, r.paired, r.excluded) == (len(mine), sum(len(v) == 2 for k, v in arms.items() if k[0] == i), sum(len(v) < 2 for k, v in arms.items() if k[0] == i))
        for at, name in ((5, "pass_rate"), (6, "seconds"), (7, "tokens")):
            v = [x[at] for x in mine if x[at] is not None]
            assert r[f"{name}_n"] == len(v) and r[f"{name}_mean"] == (pytest.approx(statistics.fmean(v)) if v else None)
            assert r[f"{name}_sd"] == (pytest.approx(statistics.stdev(v), abs=1e-15) if len(v) > 1 else None)


def test_parts_of_paths_are_those_of_the_pattern(spark):
    paths = [
        "iteration-1/a/with_skill/x", "/w/iteration-12/a b/without_skill_07/x/y/z.txt", "//iteration-3/with_skill/with_skill-2/f", "iteration-1/iteration-2/with_skill/iteration-3/s/without_skill/f", "/iteration-1//with_skill/f",
        "xiteration-1/a/with_skill/f", "iteration-1/a/with_skill-/f", "iteration-1/a/with_skillx/f", "iteration-1/a/with_skill/", "iteration-4/a/with_skill//f", "iteration-5/a/without_skill-1234567890/f", "iteration-6/a\nb/with_skill-3/f\n",
    ]
    got = {(r.n_bytes, r.iteration, r.slug, r.arm, r.repeat, r.file) for r in runs.of_paths(spark.createDataFrame([(p, i, None) for i, p in enumerate(paths)], "path string, n_bytes long, content binary")).collect()}
    found = [(i, re.search(runs.RUN, p)) for i, p in enumerate(paths)]
    assert got == {(i, int(m[1]), m[2], m[3], 1 if m[4] is None else int(m[4]) if len(m[4]) < 10 else None, m[5]) for i, m in found if m} and len(got) == 7
