"""The manifest against a plain version, with repeated and null ids, several levels, and containers of both kinds."""

import hashlib
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from millwatch.llm import merkle
from millwatch.llm import queries as Q
from millwatch.operators import ordering

SF = "/root/testdata/sf0.01"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(row):
    return h(*map(field, row))


def tree(nodes):
    """(root, path of each node): a path is (left, right) a level."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(level) > 1:
        for i, k in enumerate(at):
            run = level[k // 16 * 16 : k // 16 * 16 + 16]
            paths[i].append(("".join(run[: k % 16]), "".join(run[k % 16 + 1 :])))
        level = [h(*level[a : a + 16]) for a in range(0, len(level), 16)]
        at = [k // 16 for k in at]
    return level[0], paths


def plain(rows):
    """Rows (doc_id, source, lang, n_chars, text) to sorted result tuples."""
    groups: dict = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    ordered = {s: sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for s in names}
    low = {s: tree([leaf(r) for r in ordered[s]]) for s in names}
    root, tops = tree([low[s][0] for s in names])
    out = []
    for s, top in zip(names, tops, strict=True):
        for r, path in zip(ordered[s], low[s][1], strict=True):
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            text = r[4] if not tampered or r[4] is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])
            f = leaf((*r[:4], text))
            for a, b in path + top:
                f = h(a, f, b)
            out.append((r[0], leaf(r), low[s][0], root, h(*(a + b for a, b in path + top)), f, f == root))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def run(docs):
    return merkle.manifest(docs, tampered=merkle.every_fifth(F.col("doc_id")), tamper={"text": merkle.lower_case(F.col("text"))}).drop("position")


COLUMNS = "doc_id long, source string, lang string, n_chars long, text string"


def test_table_and_sql(spark):
    docs = Q.table(spark, SF, "documents")
    rows = [tuple(r) for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    mine = got(Q.op11_merkle(spark, SF))
    assert mine == plain(rows) and 0 < sum(not r[-1] for r in mine) < len(mine)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{SF}/documents.parquet')")
    assert sorted(map(tuple, con.sql(Q.op11_sql()).fetchall()), key=str) == mine


@pytest.mark.parametrize("n", [1, 2, 16, 17, 257, 5000])
def test_sizes(spark, n):
    r = random.Random(n)
    ids = r.sample(range(-3 * n, 3 * n), n)
    rows = [(i, "hot" if r.random() < 0.8 else f"src{r.randint(0, 400)}", "en", len(str(i)), f"Text {i}") for i in ids]
    assert got(run(spark.createDataFrame(rows, COLUMNS).repartition(5))) == plain(rows)


def test_odd(spark, monkeypatch):
    """Null, repeated and far ids, equal rows, null and empty fields, clashing names, an empty table."""
    r = random.Random(2)
    rows = [(None, None, None, None, None), (None, None, None, None, None), (None, "", "en", 1, ""), (None, "a", "en", 0, "B"), (5, "", None, 3, "É A")]
    rows += [(7, "a", "en", 4, f"T{r.randint(0, 5)}") for _ in range(200)] + [(7, None, "en", 4, None)] * 90
    rows += [(i, "a", "de", i, "long Words " * 50) for i in range(300)]
    rows += [((1 << 63) - 1, "a", "x", 1, "A"), (-(1 << 63), "a", "x", 1, "A"), (1 << 40, "é", "x", 1, "A"), (3, "z", "x", 1, "long " * 300_000)]
    docs = spark.createDataFrame(rows, COLUMNS).repartition(6)
    want = plain(rows)
    clash = docs.withColumns({"g": F.lit(1), "P": F.lit("x"), "leaf": F.lit(2), "slots": F.lit(3)})
    assert got(run(clash)) == want
    monkeypatch.setattr(merkle, "COPIES", 7)
    monkeypatch.setattr(merkle, "PACK", 50)
    monkeypatch.setattr(ordering, "ROWS", 40)
    assert got(run(docs)) == want
    empty = run(docs.limit(0))
    assert empty.count() == 0 and empty.columns == run(docs).columns
    plainly = merkle.manifest(docs.where("doc_id > 0"))
    assert plainly.where("not verified").count() == 0 and plainly.columns[-1] == "position"
