"""Each stage of the pipeline against a plain version, on sf0.001."""

import random

import corpus_pipeline as C
from pyspark.sql import functions as F

from millwatch.llm import sharding
from millwatch.llm.common import written
from millwatch.llm.queries import SHARDS, SLOTS
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(C.STAGES)
    assert list(stages) == ["language_id", "ngram_jaccard", "decontamination", "mixing", "sharding"]
    a = written(stages["language_id"](spark, docs, SF))
    assert a.columns == docs.columns and 0.98 * docs.count() <= a.count() <= docs.count()
    rows = [(r["doc_id"], r["text"]) for r in a.select("doc_id", "text").collect()]
    classes = brute.jaccard(rows, 5, 80)
    b = written(stages["ngram_jaccard"](spark, a, SF))
    assert sorted(r["doc_id"] for r in b.collect()) == sorted(d for d, (_, c) in classes.items() if d == c)
    c = written(stages["decontamination"](spark, b, SF))
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    norm = lambda t: " ".join(w.strip(".,!?;:").lower() for w in (t or "").split())
    dirty = {r["doc_id"] for r in b.collect() for t in items if f" {' '.join(norm(t).split()[1:-1])} " in f" {norm(r['text'])} "}
    assert {r["doc_id"] for r in b.collect()} - {r["doc_id"] for r in c.collect()} == dirty
    d = written(stages["mixing"](spark, c, SF))
    keys = {r["id"]: r["key"] for r in C._keyed(c).collect()}
    assert d.columns == docs.columns
    want = brute.mix([(r["doc_id"], r["source"], r["text"]) for r in c.collect()], lambda d, t: keys[d])
    assert {r["doc_id"]: r["count"] for r in d.groupBy("doc_id").count().collect()} == want
    e = stages["sharding"](spark, d, SF)
    owner = sharding.claim_slots(SHARDS, SLOTS)
    assert e.count() == d.count() and all(r["shard"] == SHARDS[owner[r["slot"]]] for r in e.collect())
    assert C.run(spark, SF).count() == e.count()


def test_odd_rows(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, an empty table and clashing names."""
    en = next(r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").where("lang = 'en' and n_chars > 400").orderBy("doc_id").collect())
    item = spark.read.parquet(f"{SF}/benchmark.parquet").where("length(text) > 150").orderBy("item_id").first()["text"]
    base = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    words = en.split()
    other = lambda k: " ".join(random.Random(k).choices(words, k=80))
    odd = [(900001, other(6), "en", "odd"), (900001, other(6), "en", "odd"), (900001, other(2), "en", "odd"), (None, other(3), "en", None), (None, other(3), "en", None), (None, other(4) + " " + item, None, "odd"), (900002, None, "en", "odd"), (900003, "", None, None), (900004, other(5) * 3000, "en", "odd")]
    docs = spark.createDataFrame(base + [(*r, None) for r in odd], spark.read.parquet(f"{SF}/documents.parquet").schema)
    docs = docs.withColumns({n: F.lit(7) for n in ("score", "Rejected", "_x", "size", "key", "id", "slot", "copies", "in0", "doc", "component_id")})
    docs = written(docs.select(*docs.columns))
    stages = dict(C.STAGES)
    a = written(stages["language_id"](spark, docs, SF))
    assert a.columns == docs.columns and not a.where("text is null or text = ''").take(1) and a.where("source = 'odd' or doc_id is null").count() == 7
    b = written(stages["ngram_jaccard"](spark, a, SF))
    assert b.columns == docs.columns and sorted((str(r["doc_id"]), r["text"][:20]) for r in b.where("source = 'odd' or doc_id is null").collect()) == sorted({(str(r[0]), r[1][:20]) for r in odd if r[1]})
    c = written(stages["decontamination"](spark, b, SF))
    gone = {r["text"] for r in b.where("source = 'odd' or doc_id is null").collect()} - {r["text"] for r in c.collect()}
    assert c.columns == docs.columns and gone == {other(4) + " " + item}
    d = written(stages["mixing"](spark, c, SF))
    assert d.columns == docs.columns and d.groupBy("doc_id", "text").count().agg(F.max("count")).first()[0] <= 3
    e = stages["sharding"](spark, d, SF)
    assert e.columns == [*(n for n in docs.columns if n != "slot"), "slot", "shard"] and e.count() == d.count() and not e.where("shard is null").take(1)
    empty = docs.limit(0)
    for name, stage in C.STAGES:
        empty = stage(spark, empty, SF)
        assert empty.count() == 0, name
