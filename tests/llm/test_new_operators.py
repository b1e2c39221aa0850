"""SimHash groups, Merkle manifests and spelling variants against brute force, with awkward and empty inputs."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from plumbline.llm import merkle, queries, simhash, spelling
from tests.llm.conftest import awkward_texts, prose

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def simhash_of(text, k=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]), 42) for i in range(max(1, len(w) - k + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots_of(prints, distance=4):
    """The least index that each fingerprint reaches, by comparing all pairs."""
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(prints))]


def simhash_groups(rows):
    prints = [simhash_of(t) for _, t in rows]
    roots = roots_of(prints)
    least = defaultdict(list)
    for (doc, _), r in zip(rows, roots, strict=True):
        least[r] += [doc] if doc is not None else []
    return Counter((doc, f"{p:016x}", min(least[r], default=None)) for (doc, _), p, r in zip(rows, prints, roots, strict=True))


def test_simhash_of_awkward_rows(spark, awkward, empty):
    rows = [r[:2] for r in awkward_texts()]
    assert Counter(tuple(r) for r in simhash.near_duplicates(awkward, 4, 4).collect()) == simhash_groups(rows)
    assert simhash.near_duplicates(empty, 4, 4).count() == 0


def test_simhash_of_the_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want = simhash_groups(rows)
    assert Counter(tuple(r) for r in queries.op11_simhash(spark, SF).collect()) == want
    assert len({c for _, _, c in want}) < len(rows)


def test_simhash_in_blocks(monkeypatch):
    text = prose(3, 700)
    whole = simhash.fingerprint(text, 4)
    monkeypatch.setattr(simhash, "_BLOCK", 64)
    assert simhash.fingerprint(text, 4) == whole == simhash_of(text)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("distance", [1, 2, 4, 5])
def test_roots_are_those_of_all_pairs(spark, distance):
    """Families around one fingerprint, chains of small steps, and strangers."""
    rng = np.random.default_rng(distance)

    def flipped(x, n):
        for b in rng.choice(64, n, replace=False):
            x ^= 1 << int(b)
        return x

    prints = {0, 1, (1 << 64) - 1}
    for size in (150, 40):
        centre = int(rng.integers(0, 1 << 62))
        prints |= {flipped(centre, int(rng.integers(0, 6))) for _ in range(size)}
    step = int(rng.integers(0, 1 << 62))
    for _ in range(30):
        prints.add(step := flipped(step, distance))
    prints |= {int(x) for x in rng.integers(0, 1 << 62, 100)}
    prints = sorted(map(signed, prints))
    want = {p: prints[r] for p, r in zip(prints, roots_of([p % (1 << 64) for p in prints], distance), strict=True)}
    got = spark.createDataFrame([(x,) for x in prints], "print long")
    assert {r.print: r.root for r in simhash.roots(got, distance).collect()} == want


def test_links_of_a_family_are_not_all_its_pairs(spark, monkeypatch):
    """Fingerprints around one centre, most within the distance of most others: a few links for each."""
    rng = np.random.default_rng(1)
    prints, staged = set(), simhash.stage
    while len(prints) < 1500:
        x = 0x0123456789ABCDEF
        for b in rng.choice(62, int(rng.integers(0, 4)), replace=False):
            x ^= 1 << int(b)
        prints.add(signed(x))
    found = []

    def counted(df, label):
        out = staged(df, label)
        found.append(out.count() if label == "links" else 0)
        return out

    monkeypatch.setattr(simhash, "stage", counted)
    got = simhash.roots(spark.createDataFrame([(x,) for x in prints], "print long"), 4).collect()
    assert {r.root for r in got} == {min(prints)} and sum(found) <= 3 * len(prints)


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def framed(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def manifest_of(rows):
    """The manifest of (doc_id, source, lang, n_chars, text) rows by hand."""
    hit = lambda r: r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
    given = lambda r: sha(*map(framed, (*r[:4], r[4].translate(LOWER) if hit(r) and r[4] is not None else r[4])))
    order = sorted(rows, key=lambda r: (r[1] is not None, (r[1] or "").encode(), r[0] is not None, r[0] or 0, sha(*map(framed, r))))

    def tree(leaves):
        """The root, and the (before, after) of each leaf level by level."""
        paths, nodes, under = [[] for _ in leaves], leaves, [[i] for i in range(len(leaves))]
        while len(nodes) > 1:
            runs = [range(i, min(i + 16, len(nodes))) for i in range(0, len(nodes), 16)]
            for run in runs:
                for i in run:
                    for leaf in under[i]:
                        paths[leaf].append(("".join(nodes[j] for j in run if j < i), "".join(nodes[j] for j in run if j > i)))
            nodes, under = [sha(*(nodes[j] for j in run)) for run in runs], [sum((under[j] for j in run), []) for run in runs]
        return nodes[0], paths

    sources = list(dict.fromkeys(r[1] for r in order))
    trees = {s: tree([sha(*map(framed, r)) for r in order if r[1] == s]) for s in sources}
    root, tops = tree([trees[s][0] for s in sources])
    out = []
    for s, top in zip(sources, tops, strict=True):
        for r, path in zip([r for r in order if r[1] == s], trees[s][1], strict=True):
            fold = given(r)
            for before, after in path + top:
                fold = sha(before, fold, after)
            out.append((r[0], sha(*map(framed, r)), trees[s][0], root, sha(*(b + a for b, a in path + top)), fold, fold == root))
    return Counter(out)


MANIFEST = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize("n", [1, 16, 17, 33, 300])
def test_manifest(spark, n):
    rows = [(i % 290 if i % 31 else None, [None, "b", "ä", "a", "b"][i % 5] if n > 1 else "s", "en" if i % 3 else None, i if i % 4 else None, prose(i, 9).title() if i % 6 else None) for i in range(n)]
    rows += rows[:2] if n > 300 else []
    df = spark.createDataFrame(rows, MANIFEST).withColumn("leaf", F.lit("x")).withColumn("slot", F.lit(1)).withColumn("tree", F.lit(2))
    got = [tuple(r) for r in merkle.manifest(df, merkle.tampered()).collect()]
    assert Counter(got) == manifest_of(rows)
    if n == 300:
        assert {r[-1] for r in got} == {True, False}


def test_manifest_of_awkward_rows(spark, awkward, empty):
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in awkward.collect()]
    want = manifest_of(rows)
    got = Counter(tuple(r) for r in merkle.manifest(awkward, merkle.tampered()).collect())
    # equal rows may stand in either order, which changes no digest of theirs but the proofs: those stand by place
    assert got == want
    assert merkle.manifest(empty, merkle.tampered()).count() == 0


def spelled(rows):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = run.translate(LOWER)
            h = zlib.crc32(f"{doc}:{w}".encode())
            if doc is not None and h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def variants(counts):
    def near(a, b):
        a, b = sorted((a, b), key=len)
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    form, n_near = {}, Counter()
    for w, n in counts.items():
        found = [x for x in counts if x != w and abs(len(x) - len(w)) <= 1 and near(x, w)]
        n_near[w] = len(found)
        best = min(found, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best and counts[best] >= 5 * n else None
    out = set()
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, n_near[w], counts[form[w]] if form[w] else None))
    return out


def test_spelling_of_the_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = {tuple(r) for r in queries.op13_spelling(spark, SF).collect()}
    want = variants(spelled(rows))
    assert got == want and any(r[1] for r in want)


def test_spelling_of_awkward_rows(spark, awkward, empty):
    text = " ".join(["WORTHY"] * 30 + ["worthy", "worthyy", "Wörthy", "worth", "orthy"] * 6 + ["ÀÉÎõüÿ×÷"] * 5 + ["x" * 5000] * 5 + ["x" * 5001] * 26)
    rows = [r[:2] for r in awkward_texts()] + [(21, text), (None, text), (21, text)]
    df = awkward.select("doc_id", "text", "h", "words").unionByName(spark.createDataFrame([(d, t, "h", "w") for d, t in rows[-3:]], "doc_id long, text string, h string, words string"))
    got = {tuple(r) for r in spelling.spelling_variants(df).collect()}
    assert got == variants(spelled(rows)) and ("x" * 5000, "x" * 5001) in {r[:2] for r in got}
    assert spelling.spelling_variants(empty).count() == 0


@pytest.mark.parametrize("block", [2, 256])
def test_tiles_find_every_single_edit(spark, monkeypatch, block):
    """All words over two letters, in blocks of two and in whole groups, with chains of forms."""
    monkeypatch.setattr(spelling, "BLOCK", block)
    rng = np.random.default_rng(7)
    words = {"".join("ab"[i] for i in rng.integers(0, 2, int(n))) for n in rng.integers(6, 10, 250)}
    counts = {w: int(5 ** rng.integers(1, 6)) for w in words}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert {tuple(r) for r in spelling.group_variants(df).collect()} == variants(counts)


@pytest.mark.parametrize("name", ["op12_merkle", "op13_spelling"])
def test_queries_and_sql_agree(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    made = con.execute(queries.ORACLES[name])
    names = [c[0] for c in made.description]
    want = Counter(made.fetchall())
    assert want and Counter(tuple(r[c] for c in names) for r in queries.QUERIES[name](spark, SF).collect()) == want
