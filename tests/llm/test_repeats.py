import hashlib
import random
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from millwatch.llm import repeats
from millwatch.llm.queries import op5_repeats
from tests.llm import brute

SCHEMA = "doc_id long, text string"


def result(df):
    return sorted(tuple(r) for r in df.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())


def corpus(seed):
    r = random.Random(seed)
    passages = ["".join(r.choice("abcdé ") for _ in range(r.randint(60, 400))) for _ in range(12)]
    docs = []
    for i in range(120):
        t = ""
        for _ in range(r.randint(0, 6)):
            p = r.choice(passages)
            a = r.randint(0, len(p) // 2)
            t += r.choice([p, p[a:], p[: len(p) - a], "".join(r.choice("xyz ") for _ in range(50)), "a" * r.randint(1, 300), "ab" * r.randint(1, 90)])
        docs.append((i, r.choice([t, t, docs[-1][1] if docs else t])))
    return docs


@pytest.mark.parametrize(("seed", "depth"), [(1, 100), (2, 64), (3, 101)])
def test_random(spark, seed, depth):
    docs = corpus(seed)
    df = spark.createDataFrame(docs, SCHEMA).repartition(6)
    assert result(repeats.remove_repeats(df, depth=depth, digest=True)) == brute.repeats(docs, depth)


def test_small_pieces(spark, monkeypatch):
    monkeypatch.setattr(repeats, "PIECE", 300)
    monkeypatch.setattr(repeats, "WINDOWS", 400)
    docs = corpus(4)
    from millwatch.llm import common

    df = spark.createDataFrame(docs, SCHEMA)
    rows = repeats.keyed(df, "doc_id", "text")
    batches = rows.select("doc", "text").toArrow().to_batches()
    sent = [b for b in repeats._send_grams(100, SimpleNamespace(value=None))(iter(batches))]
    assert sum(b.num_rows for b in sent) > 100
    data = b"".join((t or "").encode() for _, t in docs[:40])
    whole = {(int(p) + 0, int(g)) for _, p, g, _, _ in zip(*repeats.anchors(common.np.frombuffer(data, dtype=common.np.uint8), common.np.array([0, len(data)]), 100), strict=True)}
    import pyarrow as pa

    one = pa.RecordBatch.from_arrays([pa.array([data.decode()])], names=["text"])
    cut = set()
    for _, part, offs, up in repeats.long_pieces(iter([one]), "text", 100):
        row, place, gram, _, _ = repeats.anchors(part, offs, 100)
        cut |= {(int(p + up[0]), int(g)) for p, g in zip(place, gram, strict=True)}
    assert cut == whole


def test_query(spark):
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    assert result(op5_repeats(spark, "/root/testdata/sf0.001")) == brute.repeats(docs, 100)


def test_odd_rows(spark):
    long, none = "0123456789" * 30, hashlib.sha256(b"").hexdigest()
    rows = [(1, None), (2, ""), (3, "short"), (4, "short"), (5, long), (5, long), (None, long)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"m": F.lit(1), "doc": F.lit("x"), "n": F.lit(2)})
    got = {(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in repeats.remove_repeats(df).collect()}
    first = long[:109].encode()
    assert got == {(1, 0, 0, 0, b""), (2, 0, 0, 0, b""), (3, 5, 0, 0, b"short"), (4, 5, 0, 0, b"short"), (5, 300, 300, 1, b""), (None, 300, 290, 1, long[:10].encode())}
    assert len(first) == 109 and none
    assert repeats.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_common_line(spark):
    """A line that 90 % of the documents hold, with other text around it: equal to brute force, and no gram gathers."""
    r = random.Random(8)
    line = "".join(r.choice("abcdefgh ") for _ in range(260)) + "\n"
    noise = lambda n: "".join(r.choice("ijklmnop ") for _ in range(n)) + "\n"
    docs = [(i, "".join(noise(r.randint(20, 90)) + (line if r.random() < 0.9 else "") for _ in range(3))) for i in range(3000)]
    df = spark.createDataFrame(docs, SCHEMA).repartition(24)
    assert result(repeats.remove_repeats(df, digest=True)) == brute.repeats(docs, 100)
    rows = repeats.keyed(df, "doc_id", "text")
    hot = spark.sparkContext.broadcast(repeats.frequent_grams(rows, 100))
    assert hot.value is not None
    sizes = []
    for use in (hot, spark.sparkContext.broadcast(None)):
        every = rows.withColumn("places", F.sequence(F.lit(0).cast("long"), F.octet_length("text").cast("long")))
        sent = every.mapInArrow(repeats._send_windows(100, use), "gram long, doc long, m long, start long, skip int, bytes binary").where("bytes is not null")
        sizes.append(sorted(x["count"] for x in sent.groupBy("gram").count().collect()))
    assert sizes[0][-1] <= 1500 < 5000 < sizes[1][-1]


def test_comparison_in_parts(monkeypatch):
    """A gram with very many windows, in many batches, gives what it gives in one."""
    r = random.Random(9)
    gram = "".join(r.choice("abc") for _ in range(32)).encode()
    rows = []
    for d in range(400):
        left, right = (bytes(r.choice([b"xy", b"xxxxxxxxy"])[0] if r.random() < 0.9 else 97 for _ in range(40)) for _ in range(2))
        rows.append((5, d, 0, 0, 40, left + gram + right + b"z" * 20))
    batch = repeats._rows(*(repeats.np.array(c) for c in list(zip(*rows, strict=True))[:5]), [x[5] for x in rows])
    spans = lambda out: sorted({(d, x) for b in out for d, a, z in zip(b["doc"].to_pylist(), b["a"].to_pylist(), b["b"].to_pylist(), strict=True) for x in range(a, z)})
    whole = spans([repeats._resolve(repeats.pa.Table.from_batches([batch]), 100)[0]])
    monkeypatch.setattr(repeats, "WINDOWS", 800)
    parts = spans(list(repeats._compare(100)(iter([batch.slice(k, 7) for k in range(0, 400, 7)]))))
    assert whole and parts == whole
