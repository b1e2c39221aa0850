"""Operators over pages and conversations against brute force and exact round trips, and the pipeline."""

import hashlib
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from plumbline.llm import chat, common, linededup, mixing, queries, warc
from plumbline.llm.common import stage
from plumbline.llm.queries import HOSTILE
from tests.llm.conftest import prose
from tests.llm.test_text_operators import contaminated, groups

PAGES = "page_id long, url string, html string, sha1 string, bundle string, last long, size int, host string, lines int"
BIG = "<p>" + prose(1, 300) + "</p>"


def page_rows():
    return [
        (1, "http://a.test/x y\n", BIG), (2, "http://a.test/2", BIG), (3, None, BIG), (None, "http://a.test/", BIG), (4, "http://b.test", None), (5, "", ""),
        (6, "http://a.test/6", "short"), (7, "http://a.test/7", "short"), (8, "é", "<li>ÀÉ \U0001f600 " + prose(2, 200)), (9, "http://c.test", "x" * 2_500_000), (9, "http://c.test", "x" * 2_500_000),
    ]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*r, "s", "b", 1, 2, "h", 3) for r in page_rows()], PAGES)


@pytest.mark.parametrize(("copies", "hot"), [(100_000, 2000), (0, 2000), (0, 1)])
def test_warc_round_trip(spark, pages, monkeypatch, copies, hot):
    """With the copies told to all tasks, joined by their digests, and with the commonest of them apart."""
    monkeypatch.setattr(warc, "COPIES", copies)
    monkeypatch.setattr(common, "HOT_ROWS", hot)
    rows = page_rows()
    last = defaultdict(int)
    for i, _, html in rows:
        last[html or ""] = max(last[html or ""], i or 0)
    want = Counter()
    for i, _, html in rows:
        data = (html or "").encode()
        again = len(data) >= 1000 and i is not None and i < last[html]
        want[(i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", last[html] if again else None)] += 1
    assert Counter(tuple(r) for r in warc.round_trip(pages).collect()) == want
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_records_are_found_by_the_index(spark, pages, tmp_path):
    index = warc.write_archives(pages, str(tmp_path))
    at = index.where("page_id = 8").first()
    heads, block = warc.read_record(str(tmp_path), at.bundle, at.frame, at.offset, at.length)
    assert heads["WARC-Record-ID"] == "<urn:page:8>" and block.partition(b"\r\n\r\n")[2].decode() == page_rows()[8][2]


def chat_rows():
    return [
        (1, 0, "system", "be kind"), (1, 1, "user", "hi"), (1, 2, "assistant", "ok " * 3000), (1, 3, "user", None), (1, 4, "assistant", ""), (2, 1, "assistant", "b"), (2, 0, None, "a"),
        (None, 0, "user", "x"), (3, 0, "assistant", "same"), (3, 0, "assistant", "same"), (-7, 0, "user", HOSTILE), (-7, 1, "assistant", HOSTILE), (4, 0, "a:#<\\ b", "\\h\n### x: </turn>\n"),
        *((5, i, "assistant" if i % 2 else "user", prose(i, 90)) for i in range(60)),
    ]


@pytest.mark.parametrize("vocabulary", [None, queries.VOCABULARY])
def test_chat_round_trip(spark, vocabulary):
    rows = spark.createDataFrame([(*r, 9, 8, "w") for r in chat_rows()], "conv_id long, turn long, role string, text string, n long, window int, formatted string")
    windows = stage(chat.format_windows(rows, vocabulary=vocabulary), "windows")
    want = defaultdict(list)
    for conv, turn, role, text in sorted(chat_rows(), key=lambda r: (r[0] or 0, r[1], r[2] or "", r[3] or "")):
        want[conv].append((role or "", text or ""))
    got = {r.conv_id: r for r in chat.read_back(windows).collect()}
    assert set(got) == set(want)
    for conv, turns in want.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[conv].n_turns == len(turns) and got[conv].loss_chars == len(loss)
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert got[conv].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    made = windows.where("conv_id = 5").collect()
    assert len(made) > 3 and all(w.n_tokens <= chat.BUDGET for w in made) and any(w.n_repeated for w in made)
    assert chat.read_back(chat.format_windows(rows.limit(0))).count() == 0


def test_boilerplate_lines(spark):
    foot = "<p>All rights reserved</p>"
    rows = [(i, f"http://Site.test/{i}", f"<p>{prose(i, 12)}</p>{foot}<div>rare {i % 9}</div>") for i in range(40)]
    rows += [(100 + i, f"http://small.test/{i}", f"<p>{prose(i, 9)}</p>{foot}") for i in range(4)] + [(200, None, None), (201, None, ""), (None, None, foot)]
    df = spark.createDataFrame([(*r, "h", 1, "t", 2) for r in rows], "page_id long, url string, html string, host string, n_lines int, line string, pages int")
    got = {r.page_id: r for r in linededup.drop_boilerplate(df).collect()}
    assert len(got) == len(rows)
    for i in range(40):
        assert got[i].host == "site.test" and got[i].n_dropped == 1 and got[i].text == f"{prose(i, 12)}\nrare {i % 9}"
    assert got[100].n_dropped == 0 and re.search("All rights", got[100].text) and got[200].n_lines == 0
    assert linededup.drop_boilerplate(df.limit(0)).count() == 0


def test_pipeline(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, f in corpus_pipeline.STAGES[:-1]:
        after = stage(f(spark, docs, sf), name)
        assert sorted(after.columns) == sorted(corpus_pipeline.COLUMNS) and after.count() > 0
        if name == "language":
            assert {r.doc_id for r in docs.subtract(after).collect()} == {r.doc_id for r in docs.collect() if not r.text or not any(c.isalpha() for c in r.text)}
        if name == "leaks":
            assert after.exceptAll(docs).count() == 0 and after.count() < docs.count()
        docs = after
    out = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    slots = defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
    assert len(out) == docs.count() and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_long_system_turns_do_not_swell_the_windows(spark):
    """Of a long opening only a part is repeated; it is whole once, and everything is read back."""
    turns = [(1, 0, "system", "rule " * 1600), (1, 1, "system", "more")] + [(1, i, "user" if i % 2 else "assistant", f"turn {i}") for i in range(2, 200)]
    turns += [(2, 0, "system", "short"), (2, 1, "user", "x " * 4000), (2, 2, "assistant", "y")]
    rows = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    made = chat.format_windows(rows).collect()
    whole = sum(len(t[3]) for t in turns)
    assert sum(len(w.formatted) for w in made) < 3 * whole
    assert all(w.n_tokens <= chat.BUDGET or len([*chat.parse(w.formatted)]) - w.n_repeated == 1 for w in made)
    later = [w for w in made if w.conv_id == 1 and w.window > 0]
    assert later and all([*chat.parse(w.formatted)][0][1].startswith("rule rule") and w.n_repeated for w in later if w.window > 1)
    got = {r.conv_id: r.n_turns for r in chat.read_back(stage(chat.format_windows(rows), "windows")).collect()}
    assert got == {1: 200, 2: 3}
    with pytest.raises(FileNotFoundError):
        chat.format_windows(rows, vocabulary="/nowhere")


def awkward_documents():
    """Null and repeated ids, copies and near copies under any of them, all rows different texts otherwise."""
    one, near = prose(50, 150), prose(50, 150) + " more"
    return [
        *((None, prose(s, 80)) for s in range(60, 64)), (7, prose(64, 80)), (7, prose(65, 80)), (7, one), (3, near), (None, one), (8, prose(66, 80)), (8, prose(66, 80)),
        (None, prose(67, 80)), (None, prose(67, 80)), (None, "two words"), (9, None), (9, None), (None, ""),
    ]


def documents(spark, rows):
    return spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")


def test_pipeline_keeps_one_row_of_each_group(spark):
    rows = awkward_documents()
    # numbered in the order in which a group's rows are chosen, so that a group's least number is its row
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    comp, sets = groups([(i, t) for i, (_, t) in enumerate(order)], 5, 80)
    want = Counter(r for i, r in enumerate(order) if not sets[i] or comp[i] == i)
    df = documents(spark, rows)
    for docs in (df, stage(df, "docs")):
        assert Counter((r.doc_id, r.text) for r in corpus_pipeline.dedup(spark, docs, "").collect()) == want


def test_pipeline_drops_leaks_of_any_id(spark, tmp_path):
    rows = awkward_documents()
    items = [("a", " ".join(rows[0][1].split()[20:32])), ("b", rows[11][1]), ("c", "words two")]
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    dirty = [next(iter(contaminated([r], items)))[-1] for r in rows]
    assert sum(dirty) == 3
    got = corpus_pipeline.leaks(spark, documents(spark, rows), str(tmp_path))
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter(r for r, x in zip(rows, dirty, strict=True) if not x)


def test_pipeline_keeps_texts_without_any_label(spark):
    rows = awkward_documents() + [(10, "12 !"), (None, "34")]
    docs = documents(spark, rows).withColumn("lang", F.lit(None).cast("string"))
    got = corpus_pipeline.language(spark, docs, "")
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter(r for r in rows if any(c.isalpha() for c in r[1] or ""))


@pytest.mark.parametrize("sources", ["aaaaaabaaaaaabaaa", "aaaaaaaaabbbbbbcc", "a" * 17, "abababababababaca"])
def test_pipeline_mixes_as_the_sql(spark, sources):
    """Fixtures in which the entropy binds, or the repetition, or neither; the second once showed a twin without the former."""
    rows = [(d, t, "en", s, 1) for (d, t), s in zip(awkward_documents(), sources, strict=True)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", rows)
    want = Counter((d, s) for d, s, *_ in con.execute(mixing.oracle_sql()).fetchall())
    out = corpus_pipeline.mix(spark, docs, "").collect()
    assert want and Counter((r.doc_id, r.source) for r in out) == want and {tuple(r) for r in out} <= set(rows)


def test_mixing_by_language_binds_and_agrees_with_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = Counter(con.execute(queries.ORACLES["op1_mixing"]).fetchall())
    assert Counter(tuple(r) for r in queries.op1_mixing(spark, sf).collect()) == want
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert sum(want.values()) != docs.count()  # at an exponent of 1 every row would be there once


def test_mixing_in_pieces_and_by_row(spark, monkeypatch):
    """Blocks of a few tokens: their permutation and running sums are those of one sort; rows of one id go their own ways."""
    monkeypatch.setattr(mixing, "BLOCK", 40)
    rows = [(None if i % 3 else i % 7, prose(i, 5 + i % 9), "big" if i % 10 else "small") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    p = mixing.plan(docs)
    ranks = defaultdict(list)
    for r in p.passes.collect():
        ranks[r.source, r.epoch].append(r.block_rank)
    assert all(sorted(v) == list(range(len(v))) for v in ranks.values()) and max(map(len, ranks.values())) > 60
    held = Counter()
    for r in mixing.mixed(docs, p, "text", "source").collect():
        held[r.source] += len(r.text.split())
    longest = max(len(t.split()) for _, t, _ in rows)
    for r in p.sources.collect():
        assert r.target - longest < held[r.source] <= r.target
