"""Word arithmetic, substring dedup, near-dedup, components: against brute force."""

import hashlib
import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodegraph.llm import _text as T
from lodegraph.llm import minhash_near_dedup as M
from lodegraph.llm import substring_dedup as S
from lodegraph.llm.components import components

ODD = [None, "", " ", "one", "Ünï cödé x\x1cy z", "a\tb\x0bc\x0cd\re\nf", "É" * 5000, "the same " * 300]


def test_slices_and_words():
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice("aé \n\tB") for _ in range(rng.randrange(400))) for _ in range(500)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
    seen = []
    for part in T.slices(batch, "text", 3000):
        for lower in (False, True):
            col = T.column(part, "text")
            bounds, codes, vocabulary = T.words(T.lower(col) if lower else col)
            own = T.raw(vocabulary)
            for k, text in enumerate(part.column("text").to_pylist()):
                want = (text or "").encode()
                assert [own[c] for c in codes[bounds[k] : bounds[k + 1]]] == (want.lower() if lower else want).split()
        seen += part.column("text").to_pylist()
    assert seen == texts


def test_windows():
    x = T.hash_bytes([bytes([i % 5]) for i in range(40)])
    h = T.window_hashes(x, 7)
    assert len(h) == 34 and h[0] == h[5] and h[0] != h[1]
    at = T.leftmost_min(h, 9)
    assert [int(a) for a in at] == [min(range(i, i + 9), key=lambda j: (int(h[j]), j)) for i in range(26)]


def brute_substring(texts, window):
    words = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return out


@pytest.mark.parametrize("window", [1, 8, 35])
def test_substring_dedup(spark, window):
    rng = random.Random(window)
    passage = [rng.choice("abcdefgh") * 3 for _ in range(60)]
    texts = list(ODD)
    for k in range(60):
        w = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(120))]
        if k % 3 == 0:
            at = rng.randrange(len(w) + 1)
            w[at:at] = passage[rng.randrange(20) :]
        texts.append(" ".join(w))
    texts += [texts[20], texts[21], "x " * 50]
    docs = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, block string")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in S.substring_dedup(docs, window=window, block_bytes=4000).collect()}
    assert [got[i] for i in range(len(texts))] == brute_substring(texts, window)


def test_substring_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert S.substring_dedup(empty).count() == 0
    same = spark.createDataFrame([(1, "q " * 40), (1, "q " * 40), (None, None)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in S.substring_dedup(same).collect()) == [(0, 0, 0), (1, 40, 40), (1, 40, 40)]


def brute_near(texts):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [(len(sets[i]), find(i)) for i in range(len(texts))]


def sql_near(rows):
    import duckdb

    db = duckdb.connect()
    db.execute("create table documents (doc_id bigint, text varchar)")
    db.executemany("insert into documents values (?, ?)", rows)
    return sorted(map(str, db.execute(f"select doc_id, n_shingles, component_id, kept from ({M.SQL})").fetchall()))


def test_near_dedup_of_shared_ids(spark):
    a, b, c = ("".join(f"{x}{i} " for i in range(40)) for x in "abc")
    rows = [(3, a), (5, a), (5, b), (7, b + "z"), (9, None), (9, c), (8, c), (11, c), (11, ""), (12, ""), (13, "q"), (13, "r"), (None, a), (20, "q r"), (20, None)]
    got = M.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(str(tuple(r)) for r in got) == sql_near(rows)
    assert {r.doc_id: (r.component_id, r.kept) for r in got if r.doc_id in (3, 5, 7, 8, 9, 11)} == {3: (3, True), 5: (3, False), 7: (3, False), 8: (8, True), 9: (8, False), 11: (8, False)}


@pytest.mark.parametrize("block", [4, 256])
def test_near_dedup(spark, monkeypatch, block):
    monkeypatch.setattr(M, "BLOCK", block)
    monkeypatch.setattr(M, "TASK_ROWS", 4 * block)
    rng = random.Random(5)
    base = [[f"v{rng.randrange(500)}" for _ in range(120)] for _ in range(6)]
    texts = list(ODD) + ["one", "ONE", "a b c", "A b c", "c b a"]
    for k in range(150):
        w = list(base[k % 6])
        for _ in range(rng.randrange(9)):
            w[rng.randrange(len(w))] = f"n{rng.randrange(9999)}"
        texts.append(" ".join(w))
    chain = [f"c{i}" for i in range(140)]
    texts += [" ".join(chain[i * 6 : i * 6 + 80]) for i in range(10)]  # each like its neighbours alone
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, component long")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in M.near_dedup(docs).collect()}
    assert [got[i] for i in range(len(texts))] == brute_near(texts)


def test_near_dedup_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert M.near_dedup(empty).count() == 0
    rows = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (9, None)], "doc_id long, text string")
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.component_id, r.kept) for r in M.near_dedup(rows).collect())
    assert got == [(-1, None, True), (3, 3, True), (3, 3, True), (4, 3, False), (9, 9, True)]


def test_slices_of_large_tables(spark):
    """Equal texts far apart get equal sets, whatever slice they fall in."""
    long = "Ünï " + " ".join(f"Word{i}É" for i in range(3000))
    docs = spark.range(600).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, long).otherwise(F.concat(F.col("id").cast("string"), F.lit(" only"))).alias("text")).coalesce(1)
    got = M.near_dedup(docs).groupBy("component_id").count().filter("count > 1").collect()
    assert [tuple(r) for r in got] == [(0, 300)]


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(20, 60)] + [(5, 1), (1, 7), (100, 100), (3, None)], "a long, b long")
    got = {r.node: r.component for r in components(links).collect()}
    assert got == {i: 20 for i in range(20, 61)} | {1: 1, 5: 1, 7: 1, 100: 100}
    with pytest.raises(RuntimeError):
        components(links, rounds=2)
    assert components(links.limit(0)).count() == 0


def test_sha(spark):
    docs = spark.createDataFrame([(1, "é  x")], "doc_id long, text string")
    kept = S.substring_dedup(docs).first().kept_text
    assert hashlib.sha256(kept.encode()).hexdigest() == hashlib.sha256("é x".encode()).hexdigest()
