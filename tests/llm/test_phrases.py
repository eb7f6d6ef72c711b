"""Removal of passages that other documents hold, against brute force over all windows."""

import hashlib
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millwatch.llm import phrases
from millwatch.llm import queries as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(docs, window=50):
    """Rows (doc_id, text) to sorted (doc_id, n_words, n_removed, digest)."""
    first: dict = {}
    rank = lambda d: (d is not None, d or 0)
    lines = [(d, WORD.findall(t or "")) for d, t in docs]
    for d, w in lines:
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            first[k] = min(first.get(k, rank(d)), rank(d))
    out = []
    for d, w in lines:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < rank(d):
                gone[i : i + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=str)


def test_table(spark):
    for sf in ("0.001", "0.01"):
        docs = [tuple(r) for r in Q.table(spark, f"/root/testdata/sf{sf}", "documents").select("doc_id", "text").collect()]
        mine = got(Q.op12_phrases(spark, f"/root/testdata/sf{sf}"))
        assert mine == plain(docs) and sum(r[2] for r in mine) > 0


def test_sql():
    for sf in ("0.001", "0.01"):
        con = duckdb.connect()
        con.execute(f"create view documents as select * from read_parquet('/root/testdata/sf{sf}/documents.parquet')")
        docs = con.sql("select doc_id, text from documents").fetchall()
        assert sorted(map(tuple, con.sql(Q.op12_sql()).fetchall()), key=str) == plain(docs)


def corpus(r, n=250):
    """Passages at, below and above the window, shared by some or by most documents, also within one document, with one
    word changed here and there, beside near and exact copies."""
    say = lambda k: [f"w{r.randint(0, 60)}" for _ in range(k)]
    shared = [say(k) for k in (20, 30, 49, 50, 51, 60, 92, 93, 150, 400)]
    docs = []
    for i in range(n):
        w = say(r.randint(0, 120))
        for _ in range(r.randint(0, 4)):
            p = list(r.choice(shared))
            a = r.randint(0, max(0, len(p) - 40))
            p = p[a : a + r.randint(40, 400)] if r.random() < 0.5 else p
            if p and r.random() < 0.3:
                p[r.randrange(len(p))] = "X"
            k = r.randint(0, len(w))
            w = w[:k] + p + w[k:]
        if r.random() < 0.6:
            w = w + shared[1]
        gap = r.choice([" ", "  ", "\n", "\t ", "\x0b"])
        docs.append((i * 3 - 60, gap.join(w)))
    for i in range(60):
        w = WORD.findall(docs[r.randrange(n)][1])
        if w and i % 2:
            w[r.randrange(len(w))] = "Y"
        docs.append((10_000 + i, " ".join(w)))
    return docs


@pytest.mark.parametrize("seed", [1, 2])
def test_brute(spark, seed):
    docs = corpus(random.Random(seed))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    want = plain(docs)
    assert got(phrases.remove_phrases(df, digest=True)) == want
    full = phrases.remove_phrases(df)
    assert full.columns == ["doc_id", "n_words", "n_removed", "spans", "kept", "kept_sha256"] and got(full) == want
    text = dict(docs)
    for r in full.collect():
        w = WORD.findall(text[r["doc_id"]])
        gone = {k for s in r["spans"] for k in range(s["a"], s["b"])}
        assert r["kept"] == " ".join(x for k, x in enumerate(w) if k not in gone) and len(gone) == r["n_removed"]


def test_frequent_and_parts(spark, monkeypatch):
    """Grams that most documents hold come last, small pieces and shards; and texts cut in parts."""
    monkeypatch.setattr(phrases, "SAMPLE", 2)
    monkeypatch.setattr(phrases, "PIECE", 300)
    monkeypatch.setattr(phrases, "PART", 70)
    monkeypatch.setattr(phrases, "SHARDS", 3)
    monkeypatch.setattr(phrases, "BUCKET", 16)
    docs = corpus(random.Random(5), 150)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert got(phrases.remove_phrases(df, digest=True)) == plain(docs)
    assert got(phrases.remove_phrases(df, window=40)) == plain(docs, 40)


def test_odd(spark):
    long = " ".join(f"v{i % 977} u{i}" for i in range(150_000))
    many = " ".join(f"k{i}" for i in range(70))
    docs = [(None, None), (None, many), (1, ""), (2, " \t\n "), (3, "a b c"), (4, long), (5, "x " + long[:900_000]), (6, many), (6, many), (6, many + " z"), (7, many + " " + many), (8, "é " * 60), (9, "é  " * 60), (10, "é " * 70), (10, "é  " * 70)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"doc": F.lit(1), "M": F.lit("x"), "kept": F.lit(2), "shard": F.lit(3)})
    assert got(phrases.remove_phrases(df)) == plain(docs)
    assert got(phrases.remove_phrases(df, digest=True)) == plain(docs)
    assert phrases.remove_phrases(df.limit(0)).count() == 0
    assert got(phrases.remove_phrases(df.where("doc_id < 4"))) == plain([d for d in docs if d[0] is not None and d[0] < 4])


def test_a_frequent_passage_is_one_row_a_shard(spark):
    """A passage that all of 3,000 documents hold: each step's sums keep two figures, a shard gets it once."""
    r = random.Random(9)
    passage = " ".join(f"p{i}" for i in range(64))
    docs = [(i, " ".join(f"q{r.randint(0, 10**9)}" for _ in range(40)) + " " + passage) for i in range(3000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(8)
    assert [x[2] for x in sorted(got(phrases.remove_phrases(df, digest=True)), key=lambda x: x[0])] == [0] + [64] * 2999


def test_anchors_agree():
    """Equal windows have the same gram at the same place, whatever stands around them."""
    r = random.Random(3)
    inner = [f"i{k}" for k in range(80)]
    seen: dict = {}
    for _ in range(20):
        w = [f"o{r.randint(0, 9)}" for _ in range(r.randint(0, 90))] + inner + [f"o{r.randint(0, 9)}" for _ in range(60)]
        batch = pa.RecordBatch.from_arrays([pa.array([" ".join(w)])], names=["text"])
        (_, data, starts, ends, row, _, _), = phrases.word_pieces([batch], "text", 50)
        at, gram, lo, hi = phrases.anchors(phrases.sequence_prefix(data, starts, ends), row, 50, None)
        assert (np.diff(at) > 0).all() and (lo <= at).all() and (at + phrases.GRAM <= lo + 50 + (hi - lo)).all() and (hi - lo + 1).sum() == len(w) - 49
        for a, g, x, y in zip(at, gram, lo, hi, strict=True):
            for s in range(x, y + 1):
                assert seen.setdefault(tuple(w[s : s + 50]), (a - s, g)) == (a - s, g)
