"""What the operators share: tables in the shared folder, text as numpy buffers, components of a link graph."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
U64 = np.uint64


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, in one for the application, which may be removed when that has ended.
    Where the setting is unset, below a temporary one, but only if driver and executors are one process."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="millwatch-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/millwatch-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "t") -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it again: lineage ends in files that every executor sees."""
    path = f"{shared_dir(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def let_go(spark: SparkSession) -> None:
    """Spark removes a shuffle's files when the driver's garbage is collected; after a large shuffle that nothing reads any
    more, that is asked for, so that its room is free for the next."""
    spark.sparkContext._jvm.System.gc()


def bare(df: DataFrame) -> DataFrame:
    """df with its columns named in0, in1, ... by place, so that no name of the input can meet one of an operator's."""
    return df.toDF(*[f"in{i}" for i in range(len(df.columns))])


def at(df: DataFrame, name: str) -> str:
    """The name that bare() gives to a column of df: the one of that name, else one that differs in case only."""
    if name in df.columns:
        return f"in{df.columns.index(name)}"
    low = [c.lower() for c in df.columns]
    if name.lower() not in low:
        raise ValueError(f"no column {name}")
    return f"in{low.index(name.lower())}"


def given(df: DataFrame, new) -> list[F.Column]:
    """What bare() renamed, under df's own names, without columns whose names an operator's new ones take."""
    taken = {c.lower() for c in new}
    return [F.col(f"in{i}").alias(c) for i, c in enumerate(df.columns) if c.lower() not in taken]


def word_count(text) -> F.Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


# ---- components ---------------------------------------------------------------------------------------------------


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node that has an edge: root is the smallest node that the edges reach. Alternates large-star and small-star steps, so
    the number of rounds grows with the logarithm of the longest path; each round is written, so a lost executor
    costs one round. Rows stay near the number of edges. Null ends and loops add nothing."""
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a <> b").distinct()
    e = written(e, "edges")
    last = None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
        e = written(small.where("a <> b").distinct(), "edges")
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == last:
            out = e.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
            return out.unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        last = now


# ---- sets of ids as bits ------------------------------------------------------------------------------------------

#: Least and most bits of a filter: 128 KB to 32 MB.
FILTER_BITS = (1 << 20, 1 << 28)


def _hash(key, seed: int):
    return F.xxhash64(F.col(key), F.lit(seed)) if seed else F.xxhash64(F.col(key))


def bitmap(ids: DataFrame, id_col: str, seed: int = 0) -> tuple[DataFrame, int]:
    """The ids as bits of their hash: (_bucket, _bits), rows of 4 KB; and how many bits there are, some 16 an id as far
    as the bound allows, so the table may be broadcast whatever the number of ids."""
    size = FILTER_BITS[0]
    n = ids.count()
    while size < min(16 * n, FILTER_BITS[1]):
        size *= 2
    place = F.pmod(_hash(id_col, seed), F.lit(size)) + 1
    return ids.select(place.alias("_p")).groupBy(F.bitmap_bucket_number("_p").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_p")).alias("_bits")), size


def flagged(df: DataFrame, key: str, bits: tuple[DataFrame, int], out: str, seed: int = 0) -> DataFrame:
    """df with `out`: the key may be among the bitmap's ids."""
    table, size = bits
    place = F.pmod(_hash(key, seed), F.lit(size)) + 1
    there = df.withColumn("_p", place).withColumn("_bucket", F.bitmap_bucket_number("_p")).join(F.broadcast(table), "_bucket", "left")
    byte = F.conv(F.hex(F.expr("substring(_bits, cast(bitmap_bit_position(_p) div 8 as int) + 1, 1)")), 16, 10).cast("int")
    bit = F.getbit(byte, (F.bitmap_bit_position("_p") % 8).cast("int")) == 1
    return there.withColumn(out, F.coalesce(bit, F.lit(False))).drop("_p", "_bucket", "_bits")


def maybe_in(df: DataFrame, key: str, ids: DataFrame, id_col: str) -> DataFrame:
    """The rows of df whose key may be among ids, before the join that decides."""
    return flagged(df, key, bitmap(ids, id_col), "_maybe").where("_maybe").drop("_maybe")


def sifted(df: DataFrame, key: str, ids: DataFrame, always: str = "false") -> DataFrame:
    """The rows of df whose key may be among ids (a written table with one column of that name), and those of which
    `always` holds; too many rows must cost work only. By the bits of two hashes, without a shuffle (one key in 250 too
    many); where ids are too many for the bits to say much, by a join that Spark splits at large keys."""
    bits = bitmap(ids, key)
    if 4 * ids.count() <= bits[1]:
        some = flagged(df, key, bits, "_maybe").where(f"_maybe or {always}").drop("_maybe")
        return flagged(some, key, bitmap(ids, key, 1), "_maybe", 1).where(f"_maybe or {always}").drop("_maybe")
    return df.where(f"not ({always})").join(ids, key, "left_semi").unionByName(df.where(always))


# ---- groups of very different sizes ------------------------------------------------------------------------------

#: Groups with more rows are few (the rows divided by this), so that their figures may be broadcast.
HOT_GROUP = 1 << 20


def meet_groups(rows: DataFrame, groups: DataFrame, key: str, count: str) -> DataFrame:
    """rows with the columns of groups (a row a key, with its number of rows in `count`), null where there is none. Rows
    of the large groups meet them by broadcast; the others meet by a shuffle in which no key has many rows."""
    new = [c for c in groups.columns if c not in (key, count)]
    side = lambda g, mark: g.select(F.col(key).alias(f"{mark}k"), *[F.col(c).alias(f"{mark}{c}") for c in new])
    out = rows.join(F.broadcast(side(groups.where(F.col(count) > HOT_GROUP), "_h")), F.col(key) == F.col("_hk"), "left")
    # a row that has met its group takes a key that no group has and that spreads
    spread = F.when(F.col("_hk").isNull() & F.col(key).isNotNull(), F.col(key)).otherwise(F.concat(F.lit("\0"), F.xxhash64(*rows.columns).cast("string")))
    out = out.withColumn("_ck", spread).join(side(groups.where(F.col(count) <= HOT_GROUP), "_c"), "_ck", "left")
    return out.select(*rows.columns, *[F.coalesce(f"_h{c}", f"_c{c}").alias(c) for c in new])


# ---- text as bytes ------------------------------------------------------------------------------------------------


def pieces(batches: Iterator[pa.RecordBatch], col: str, most: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with at most so many bytes of text (one row, if it alone has more), the bytes of the text
    one after the other, and each row's offset (one more than rows). Null is empty."""
    for batch in batches:
        k = batch.schema.get_field_index(col)
        text = pc.fill_null(batch.column(k).cast(pa.large_binary()), b"")
        if not len(text):
            continue
        if text.offset:
            text = pa.concat_arrays([text, text.slice(0, 0)])
        offs = np.frombuffer(text.buffers()[1], dtype=np.int64, count=len(text) + 1 + text.offset)[text.offset :]
        data = np.frombuffer(text.buffers()[2], dtype=np.uint8) if text.buffers()[2] is not None and offs[-1] else np.zeros(0, np.uint8)
        i, n = 0, len(text)
        while i < n:
            j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, side="right")) - 1)
            j = min(j, n)
            yield batch.slice(i, j - i), data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
            i = j


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


BASE = 0x9E3779B97F4A7C15 | 1
_POW: dict[int, np.ndarray] = {}


def powers(n: int, base: int = BASE) -> np.ndarray:
    """base ** 0 ... base ** (n - 1) modulo 2 ** 64."""
    have = _POW.get(base)
    if have is None or len(have) < n:
        x = np.full(max(n, 1 << 16), base, dtype=U64)
        x[0] = 1
        have = np.multiply.accumulate(x)
        if n <= 1 << 23:
            _POW[base] = have
    return have[:n]


INVERSE = pow(BASE, -1, 1 << 64)


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """P with P[j] - P[i] the hash of data[i:j], times BASE ** i."""
    out = np.zeros(len(data) + 1, dtype=U64)
    np.cumsum((data.astype(U64) + U64(1)) * powers(len(data)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((prefix[end] - prefix[start]) * powers(len(prefix), INVERSE)[start] + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words(data: np.ndarray, offs: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of all rows in order: start, end, and the row of each."""
    n = len(data)
    if not n:
        z = np.zeros(0, dtype=np.int64)
        return z, z, z
    solid = ~_SPACE[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offs] = True
    start = solid.copy()
    start[1:] &= ~solid[:-1] | edge[1:n]
    end = solid.copy()
    end[:-1] &= ~solid[1:] | edge[1:n]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(offs, starts, side="right") - 1


def shingles(data: np.ndarray, offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct k-word shingles of each row, by row and hash: ASCII letters lower-cased; a row
    with 1 to k - 1 words has its whole sequence as one."""
    data = _LOWER[data]
    starts, ends, row = words(data, offs)
    if not len(starts):
        return row, np.zeros(0, dtype=U64)
    h = span_hash(prefix_hash(data), starts, ends)
    first = np.searchsorted(row, np.arange(len(offs) - 1))
    count = np.diff(np.append(first, len(row)))
    acc = np.zeros(len(h), dtype=U64)
    many = np.minimum(count, k)[row]  # words of a shingle
    place = np.arange(len(h)) - first[row]
    ok = place + many <= count[row]
    idx = np.flatnonzero(ok)
    acc = many[idx].astype(U64)
    for j in range(k):
        has = j < many[idx]
        at = np.minimum(idx + j, len(h) - 1)
        acc = np.where(has, mix(acc * U64(0xA24BAED4963EE407) + h[at]), acc)
    r = row[idx]
    order = np.lexsort((acc, r))
    r, acc = r[order], acc[order]
    keep = np.ones(len(r), dtype=bool)
    keep[1:] = (r[1:] != r[:-1]) | (acc[1:] != acc[:-1])
    return r[keep], acc[keep]
