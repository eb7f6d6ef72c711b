"""Approximate nearest neighbours: an inverted-file index whose lists are scanned by adaptive dimension sampling.

Equal vectors are one entry with its smallest ids. Entries go to the list of their nearest centroid; centroids come
from k-means on a bounded sample (`SAMPLE` entries, by hash). A query visits its nearest lists until they hold
`visit` of all entries and at least `LEAST` more than it needs (where that is all, the search is exact). A visited list is scanned in blocks: vectors are
rotated by one random orthogonal matrix and laid out in column blocks; after each block the partial distance, scaled
to all dimensions, is tested against the best distances found so far, and a candidate that the test rejects
(chance of a false rejection set by `EPSILON`) reads no further block. A list's queries are scanned together: the first
`DENSE` blocks as matrix products, the others for the pairs that are left. What survives is measured exactly, in double
precision, on the original vectors.

A list with many entries is cut into blocks of `BLOCK` entries and its queries into blocks of `QUERIES`, so no task
holds an unbounded list.

Defined results: null, empty and zero vectors, and vectors with a null or non-finite component, take no part, nor do
vectors of another dimension than the most frequent one (the smaller, at a tie); rows that repeat an id keep one of
them (the first by vector); fewer candidates than asked for give them all; ties go to the smaller id; an empty table
gives an empty result. Output columns are fixed, so other columns never clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millwatch.llm.common import written

SAMPLE, LISTS, BLOCK, QUERIES, LEAST = 1 << 15, 1 << 12, 4096, 512, 4096
COLUMNS, DENSE = 16, 2
EPSILON = 3.5


def usable(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(vec_id long, vector array<double>) of the rows that take part."""
    v = F.col(f"`{vector}`").cast("array<double>")
    rows = df.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.transform(v, lambda x: x + F.lit(0.0)).alias("vector")).where("vec_id is not null and vector is not null")
    rows = rows.where(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0))
    return rows


def rotation(dim: int, seed: int = 5) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """k centroids of the sample's rows by Lloyd's rounds; a list that empties keeps its place."""
    c = x[np.random.default_rng(seed).choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = np.concatenate([((c**2).sum(1) - 2 * part @ c.T).argmin(1) for part in np.array_split(x, max(1, len(x) // 4096))])
        n = np.bincount(near, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def _exact(queries: np.ndarray, base: np.ndarray, q: np.ndarray, i: np.ndarray, most: int = 1 << 15) -> np.ndarray:
    """Squared distances of the pairs (q, i)."""
    out = np.zeros(len(q))
    for a in range(0, len(q), most):
        out[a : a + most] = ((base[i[a : a + most]] - queries[q[a : a + most]]) ** 2).sum(axis=1)
    return out


def scan(queries: np.ndarray, base: np.ndarray, turn: np.ndarray, want: int, chunk: int = 1024) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the indices and exact distances of the `want` nearest rows of base that the tests let through."""
    dim, many = base.shape[1], len(queries)
    cols = [slice(a, min(a + COLUMNS, dim)) for a in range(0, dim, COLUMNS)]
    asked, rotated = queries @ turn, base @ turn
    square = lambda x, y: np.maximum((x**2).sum(1)[:, None] + (y**2).sum(1) - 2 * x @ y.T, 0.0)
    best_q, best_i, best_d = (np.zeros(0, dtype=t) for t in (np.int64, np.int64, float))
    bound = np.full(many, np.inf)
    begin = 0
    while begin < len(base):
        # the first chunk, whole, gives the first bounds
        stop = min(begin + (chunk if begin else max(want, chunk // 4)), len(base))
        if not begin:
            part = square(queries, base[:stop])
            kth = np.partition(part, min(want, stop) - 1, axis=1)[:, min(want, stop) - 1]
            q, i = np.nonzero(part <= kth[:, None] * (1 + 1e-9) + 1e-12)
        else:
            part, alive = np.zeros((many, stop - begin)), np.ones((many, stop - begin), dtype=bool)
            room = lambda seen: bound * (1 + EPSILON / np.sqrt(seen)) ** 2 * (seen / dim)
            for c in cols[:DENSE]:
                part += square(asked[:, c], rotated[begin:stop, c])
                alive &= part <= room(c.stop)[:, None]
            q, i = np.nonzero(alive)
            left = part[q, i]
            i = i + begin
            for c in cols[DENSE:-1]:
                left = left + ((rotated[i, c] - asked[q, c]) ** 2).sum(axis=1)
                keep = left <= room(c.stop)[q]
                q, i, left = q[keep], i[keep], left[keep]
        d = _exact(queries, base, q, i)
        new = d <= bound[q]
        best_q, best_i, best_d = (np.concatenate([x, y[new]]) for x, y in ((best_q, q), (best_i, i), (best_d, d)))
        order = np.lexsort((best_i, best_d, best_q))
        best_q, best_i, best_d = best_q[order], best_i[order], best_d[order]
        place = np.arange(len(best_q)) - np.searchsorted(best_q, best_q)
        top = place < want
        best_q, best_i, best_d, place = best_q[top], best_i[top], best_d[top], place[top]
        last = place == want - 1
        bound[best_q[last]] = best_d[last]
        begin = stop
    edge = np.searchsorted(best_q, np.arange(many + 1))
    return [(best_i[a:b], np.sqrt(best_d[a:b])) for a, b in zip(edge[:-1], edge[1:], strict=True)]


def nearest(df: DataFrame, queries: DataFrame, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding", visit: float = 0.5) -> DataFrame:
    """(query_id long, rank int, vec_id long, score double): the k nearest found of each row of `queries` (a column
    query_id, ids of df), itself apart, by Euclidean distance."""
    spark = df.sparkSession
    rows = usable(df, vec_id, vector)
    dims = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if dims is None:
        return spark.createDataFrame([], schema)
    dim = dims["d"]
    rows = rows.where(F.size("vector") == dim).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    want = k + 1  # one may be the query itself
    ranked = rows.withColumn("_n", F.row_number().over(W.partitionBy("vector").orderBy("vec_id"))).where(F.col("_n") <= want)
    entries = ranked.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).withColumn("entry", F.col("ids")[0])
    entries = written(entries.select("entry", "ids", "vector"), "entries")
    total = entries.count()
    lists = max(1, min(LISTS, int(2 * math.sqrt(total)), total))
    sample = entries.where(F.pmod(F.xxhash64("entry"), F.lit(1 << 30)) < int(min(1.0, SAMPLE / total) * (1 << 30))).select("vector").toPandas()["vector"]
    sample = np.array(sample.tolist()) if len(sample) else np.array([r[0] for r in entries.select("vector").limit(1).collect()])
    centre = spark.sparkContext.broadcast(kmeans(sample, min(lists, len(sample))))
    turn = spark.sparkContext.broadcast(rotation(dim))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = centre.value
        for b in batches:
            if len(b):
                x = np.array(b["vector"].tolist())
                b["list"] = ((c**2).sum(1) - 2 * x @ c.T).argmin(1)
                yield b[["entry", "list", "ids", "vector"]]

    index = written(entries.mapInPandas(assign, "entry long, list int, ids array<long>, vector array<double>"), "index")
    sizes = {r["list"]: r["n"] for r in index.groupBy("list").agg(F.count("*").alias("n")).collect()}  # a row a list
    held = spark.sparkContext.broadcast(np.array([sizes.get(i, 0) for i in range(len(centre.value))]))
    enough = max(int(visit * total), min(total, want + LEAST))

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c, n = centre.value, held.value
        for b in batches:
            if len(b):
                x = np.array(b["vector"].tolist())
                order = ((c**2).sum(1) - 2 * x @ c.T).argsort(axis=1)
                upto = np.cumsum(n[order], axis=1)
                stop = (upto < enough).sum(axis=1) + 1
                for i, (e, v) in enumerate(zip(b["entry"], b["vector"], strict=True)):
                    near = order[i, : stop[i]]
                    near = near[n[near] > 0]
                    yield pd.DataFrame({"entry": e, "list": near, "vector": [v] * len(near)})

    asked = queries.select(F.col("query_id").cast("long").alias("query_id")).where("query_id is not null").distinct()
    asked = asked.join(rows, asked["query_id"] == rows["vec_id"]).select("query_id", "vector")
    asked = written(asked.join(entries.select("entry", "vector"), "vector").select("query_id", "entry", "vector"), "asked")
    once = asked.groupBy("entry").agg(F.min("vector").alias("vector"))
    visits = once.mapInPandas(probe, "entry long, list int, vector array<double>")
    blocks = F.create_map(*[F.lit(x) for i, n in sizes.items() if n > BLOCK for x in (i, -(-n // BLOCK))]) if any(n > BLOCK for n in sizes.values()) else F.create_map().cast("map<int,int>")
    cuts = F.coalesce(blocks[F.col("list")], F.lit(1))
    salt = lambda col, n: F.pmod(F.xxhash64(col), n).cast("int")
    per_list = visits.groupBy("list").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("q"))
    per_list = written(per_list, "visits")
    left = visits.join(F.broadcast(per_list), "list").withColumn("qb", salt("entry", F.col("q"))).withColumn("vb", F.explode(F.sequence(F.lit(0), cuts - 1))).select("list", "qb", "vb", "entry", "vector")
    right = index.join(F.broadcast(per_list), "list").withColumn("vb", salt("entry", cuts)).withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("q") - 1))).select("list", "qb", "vb", "entry", "ids", "vector")

    def search(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        got = []
        if len(a) and len(b):
            b = b.sort_values("entry", ignore_index=True)
            base, ids = np.array(b["vector"].tolist()), b["ids"]
            for e, (idx, dist) in zip(a["entry"], scan(np.array(a["vector"].tolist()), base, turn.value, want), strict=True):
                got += [(e, v, d) for i, d in zip(idx, dist, strict=True) for v in ids[i]]
        return pd.DataFrame(got, columns=["entry", "vec_id", "score"]).astype({"entry": "int64", "vec_id": "int64", "score": "float64"})

    found = left.groupBy("list", "qb", "vb").cogroup(right.groupBy("list", "qb", "vb")).applyInPandas(search, "entry long, vec_id long, score double")
    found = found.withColumn("_n", F.row_number().over(W.partitionBy("entry").orderBy("score", "vec_id"))).where(F.col("_n") <= want).drop("_n")
    pairs = asked.select("query_id", "entry").join(found, "entry").where("query_id <> vec_id")
    return pairs.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
