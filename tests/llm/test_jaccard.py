import random

import pytest
from pyspark.sql import functions as F

from millwatch.llm import jaccard
from millwatch.llm.queries import op4_jaccard
from tests.llm import brute

SCHEMA = "doc_id long, text string"


def result(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


def corpus(seed, n=220):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    line = " ".join(r.choice(vocabulary) for _ in range(25))
    texts = []
    for i in range(n):
        if i and r.random() < 0.6:
            w = r.choice(texts).split()
            for _ in range(r.randint(0, max(1, len(w) // 25))):
                w[r.randrange(len(w))] = r.choice(vocabulary)
        else:
            w = [r.choice(vocabulary) for _ in range(r.choice([1, 2, 3, 5, 30, 60, 120]))]
        texts.append(" ".join(w) + (" " + line if r.random() < 0.1 else ""))
    return list(enumerate(texts))


@pytest.mark.parametrize(("seed", "words", "percent"), [(1, 4, 85), (2, 5, 80), (3, 2, 60)])
def test_random(spark, seed, words, percent):
    docs = corpus(seed)
    got = result(jaccard.link_classes(spark.createDataFrame(docs, SCHEMA).repartition(5), words=words, percent=percent))
    assert got == brute.jaccard(docs, words, percent)


@pytest.mark.parametrize("block", [100, 600, 3000])
def test_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "COMMON", 5)
    monkeypatch.setattr(jaccard, "PIVOTS", 2)
    monkeypatch.setattr(jaccard, "FEW", 0 if block == 600 else 1000)
    docs = corpus(5)
    assert result(jaccard.link_classes(spark.createDataFrame(docs, SCHEMA), words=4, percent=85)) == brute.jaccard(docs, 4, 85)


def test_large_class(spark, monkeypatch):
    """A class of near copies far above a block: pivots join it, no task gets more than some blocks, no link is lost."""
    monkeypatch.setattr(jaccard, "BLOCK", 2000)
    r = random.Random(6)
    base = [f"w{r.randrange(3000)}" for _ in range(120)]
    docs = []
    for i in range(400):
        w = list(base)
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
        docs.append((i, " ".join(w)))
    docs += [(1000 + i, " ".join([*base[:60], *(f"y{i // 2}-{j}" for j in range(60))])) for i in range(60)]
    got = result(jaccard.link_classes(spark.createDataFrame(docs, SCHEMA), words=4, percent=85))
    assert got == brute.jaccard(docs, 4, 85)
    members = spark.createDataFrame([(0, d, sorted(hash(s) for s in brute.shingle_set(t, 4))) for d, t in docs], "cell long, rep long, tokens array<long>").withColumn("n", F.size("tokens").cast("long"))
    roots = {x["node"]: x["root"] for x in jaccard.components(jaccard.search_cells(members, 85)).collect()}
    assert {d: roots.get(d, d) for d, _ in docs} == {d: c for d, (_, c) in got.items()}


def test_query(spark):
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    assert result(op4_jaccard(spark, "/root/testdata/sf0.001")) == brute.jaccard(docs, 4, 85)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n "), (4, "a"), (5, "A"), (5, "A"), (6, "a b"), (None, "x y z"), (None, None), (7, "q " * 60000), (8, "Q " * 60000)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"n": F.lit(1), "token": F.lit("x")})
    got = sorted((str(r[0]), r[1], str(r[2])) for r in jaccard.link_classes(df, words=4, percent=85).collect())
    assert got == sorted([("1", 0, "1"), ("2", 0, "2"), ("3", 0, "3"), ("4", 1, "4"), ("5", 1, "4"), ("6", 1, "6"), ("None", 1, "None"), ("None", 0, "None"), ("7", 1, "7"), ("8", 1, "7")])
    assert jaccard.link_classes(spark.createDataFrame([], SCHEMA)).count() == 0
