"""Global order without a global sort in one task.

A table with more than `ROWS` rows is dealt to ranges of the whole order (key and id, so that a key which many rows
share is cut too), about `ROWS` rows each, and stored with the range's number. What a row needs to know of the ranges
before its own (how many rows, what sum, which last value) comes from one small row a range, so no task orders more
than a range. A table of at most `ROWS` rows is one range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millwatch.sources.io import stored

#: Rows of a range. Spark's range partitioner samples, so a range may hold some three times as many.
ROWS = 1 << 19
#: Ranges whose figures (some numbers each) may be broadcast: 69 billion rows.
MOST_RANGES = 1 << 17
#: Groups whose figures may be broadcast; rows from which a group counts as heavy (such groups are few: the rows by this).
MOST_GROUPS, HEAVY = 1 << 17, 1 << 19


def ranges(df: DataFrame, order: list[Column], n: int | None = None) -> tuple[DataFrame, int]:
    """df with `_b` int, rows of a smaller range coming before those of a larger in the order; and the number of
    ranges. n: the number of rows, or a bound, where the caller knows it; else df is stored first, as counting, sampling
    and dealing it would each make it again."""
    if n is None:
        df = stored(df, "unordered")
        n = df.count()
    parts = max(1, -(-n // ROWS))
    if parts == 1:
        return df.withColumn("_b", F.lit(0)), 1
    # stored at once: the ranges' bounds are those of this one shuffle, also for tasks that run again
    return stored(df.repartitionByRange(parts, *order).withColumn("_b", F.spark_partition_id()), "ranges"), parts


def are_light(df: DataFrame, within: list[str]) -> bool:
    """Whether no group has more rows than a range."""
    return (df.groupBy(*within).agg(F.count("*").alias("_n")).agg(F.max("_n")).first()[0] or 0) <= ROWS


def by_key(key: str, row_id: str, descending: bool = False) -> list[Column]:
    return [F.col(key).desc_nulls_last() if descending else F.col(key).asc_nulls_last(), F.col(row_id).asc()]


def meet(rows: DataFrame, small: DataFrame, on: list[str], parts: int | None = None) -> DataFrame:
    """Joins rows to the figures of their range or group; groups may be null. parts: small has a row a range, of which
    there are so many; it is broadcast up to MOST_RANGES, and beyond that shuffled, a range's rows being one task's."""
    right = small.select(*[F.col(c).alias(f"_j_{c}") for c in on], *[c for c in small.columns if c not in on])
    if parts is not None and parts <= MOST_RANGES:
        right = F.broadcast(right)
    cond = F.lit(True)
    for c in on:
        cond = cond & rows[c].eqNullSafe(right[f"_j_{c}"])
    return rows.join(right, cond, "left").drop(*[f"_j_{c}" for c in on])


def meet_groups(rows: DataFrame, groups: DataFrame, on: list[str], count: str | None = None) -> DataFrame:
    """rows with the other columns of groups, a row for each key (null being one), or nulls where there is none. Up to
    MOST_GROUPS groups are broadcast. Beyond, heavy groups are, and only rows of light ones, dealt by key, meet theirs
    in a shuffle; a row that has met a heavy group takes a place of its own there. count: the column with a group's
    number of rows; where it is left out, heavy keys are counted first."""
    new = [c for c in groups.columns if c not in (*on, count)]
    groups = stored(groups, "groups")
    many = groups.limit(MOST_GROUPS + 1).count()
    side = lambda g, mark: g.select(*[F.col(c).alias(f"_{mark}k{i}") for i, c in enumerate(on)], *[F.col(c).alias(f"_{mark}v{i}") for i, c in enumerate(new)], F.lit(1).alias(f"_{mark}h"))

    def equal(left: DataFrame, right: DataFrame, mark: str) -> Column:
        cond = F.lit(True)
        for i, c in enumerate(on):
            cond = cond & left[c].eqNullSafe(right[f"_{mark}k{i}"])
        return cond

    gone = lambda mark: [f"_{mark}h", *[f"_{mark}k{i}" for i in range(len(on))], *[f"_{mark}v{i}" for i in range(len(new))]]
    heavy = None
    if many > MOST_GROUPS:
        sizes = groups.select(*on, F.col(count).alias("_n")) if count else rows.groupBy(*on).agg(F.count("*").alias("_n"))
        heavy = stored(sizes.where(F.col("_n") > HEAVY).select(*on), "heavy")
        heavy = heavy if 0 < heavy.count() <= MOST_GROUPS else None
    if heavy is None:
        light = side(groups, "l")
        light = F.broadcast(light) if many <= MOST_GROUPS else light
        return rows.join(light, equal(rows, light, "l"), "left").withColumns({c: F.col(f"_lv{i}") for i, c in enumerate(new)}).drop(*gone("l"))
    mark = heavy.select(*[F.col(c).alias(f"_mk{i}") for i, c in enumerate(on)])
    hot = groups.join(F.broadcast(mark), equal(groups, mark, "m")).drop(*mark.columns)
    # 0 for every light group; a literal would be folded away and leave the join without the key that spreads rows
    hot, light = F.broadcast(side(hot, "h")), side(groups, "l").withColumn("_ls", F.pmod(F.xxhash64(*[f"_lk{i}" for i in range(len(on))]), F.lit(1)).cast("long"))
    out = rows.join(hot, equal(rows, hot, "h"), "left")
    # pmod leaves out 0, where the light groups are
    out = out.withColumn("_s", F.when(F.col("_hh").isNull(), F.lit(0).cast("long")).otherwise(F.pmod(F.xxhash64(*rows.columns), F.lit(1 << 40)) + 1))
    out = out.join(light, equal(out, light, "l") & (out["_s"] == light["_ls"]), "left")
    return out.withColumns({c: F.coalesce(f"_hv{i}", f"_lv{i}") for i, c in enumerate(new)}).drop(*gone("h"), *gone("l"), "_s", "_ls")


def running(df: DataFrame, order: list[Column], sums: dict[str, Column], within: list[str] | None = None, inclusive: bool = True, totals: bool = False, n: int | None = None, keep: bool = False) -> DataFrame:
    """df with running sums in the order, over all rows or within groups, all in one pass; with totals also the sum of
    the row's whole group as <name>_total. keep leaves the range's number `_b` in. Where no group
    is larger than a range, groups are ordered as they are."""
    within, values = within or [], {f"_v_{k}": v for k, v in sums.items()}
    df = df.withColumns(values)
    if within and n is None:
        df = stored(df, "unordered")
        n = df.count()
    if within and n > ROWS and are_light(df, within):
        b, parts = df.withColumn("_b", F.lit(0)), 1
    else:
        b, parts = ranges(df, order, n)
    frame = W.partitionBy(*within, "_b").orderBy(*order).rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    run = b.withColumns({k: F.coalesce(F.sum(f"_v_{k}").over(frame), F.lit(0)) for k in sums})
    if totals and parts == 1:
        run = run.withColumns({f"{k}_total": F.sum(f"_v_{k}").over(W.partitionBy(*within, "_b")) for k in sums})
    run = run.drop(*[f"_v_{k}" for k in sums])
    if parts > 1:
        per = b.groupBy(*within, "_b").agg(*[F.sum(f"_v_{k}").alias(f"_s_{k}") for k in sums])
        group = W.partitionBy(*within)
        before = group.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
        more = {f"{k}_total": F.sum(f"_s_{k}").over(group) for k in sums} if totals else {}
        per = per.withColumns({f"_o_{k}": F.coalesce(F.sum(f"_s_{k}").over(before), F.lit(0)) for k in sums} | more).drop(*[f"_s_{k}" for k in sums])
        run = meet(run, per, [*within, "_b"], None if within else parts).withColumns({k: F.col(k) + F.col(f"_o_{k}") for k in sums}).drop(*[f"_o_{k}" for k in sums])
    return run if keep else run.drop("_b")


def prefix(df: DataFrame, key: str, row_id: str, value: Column, out: str, within: list[str] | None = None, descending: bool = False, inclusive: bool = True) -> DataFrame:
    """df with `out`: the running sum of value in the order (key, id), nulls last, over all rows or within groups."""
    return running(df, by_key(key, row_id, descending), {out: value}, within, inclusive)


def global_index(df: DataFrame, key: str, row_id: str, out: str = "idx", within: list[str] | None = None, descending: bool = False, n: int | None = None) -> DataFrame:
    """df with `out` long: the row's place, from 0, in the order (key, id), nulls last. n: the number of rows, where the
    caller knows it."""
    return running(df, by_key(key, row_id, descending), {out: F.lit(1).cast("long")}, within, inclusive=False, n=n).withColumn(out, F.col(out).cast("long"))


def chunk_ids(df: DataFrame, key: str, row_id: str, size: int, out: str = "chunk_id") -> DataFrame:
    """Time chunks: the place in time order divided by the chunk's size."""
    if size <= 0:
        raise ValueError("chunk size must be positive")
    return global_index(df, key, row_id, "_i").withColumn(out, F.expr(f"cast(_i div {size} as int)")).drop("_i")


def key_counts(dense: DataFrame, asks: dict[str, tuple[Column, bool]], n: int | None = None) -> DataFrame:
    """(_k, a column for each ask) of distinct keys (_k, _all = rows with it): the rows whose key is below the ask's bound
    (an expression of _k), or not above it where that is inclusive. Bounds are points in the order of the keys and take
    the running count there, so no frame and no bucket depends on how far a bound is from its key."""
    point = lambda x, side, count, tag: F.struct(x.cast("double").alias("_x"), F.lit(side).alias("_side"), count.cast("long").alias("_c"), F.lit(tag).alias("_tag"))
    points = [point(F.col("_k"), 1, F.col("_all"), -1), *[point(x, 2 if inclusive else 0, F.lit(0), i) for i, (x, inclusive) in enumerate(asks.values())]]
    line = dense.where("_k is not null").select("_k", F.explode(F.array(*points)).alias("_p")).select("_k", "_p.*")
    line = running(line, [F.col("_x").asc(), F.col("_side").asc(), F.col("_tag").asc(), F.col("_k").asc()], {"_up": F.col("_c")}, n=n).where("_tag >= 0")
    return line.groupBy("_k").agg(*[F.max(F.when(F.col("_tag") == i, F.col("_up"))).alias(name) for i, name in enumerate(asks)])


def trailing_counts(df: DataFrame, key: str, row_id: str, widths: dict[str, float], place: str | None = None, n: int | None = None) -> DataFrame:
    """df with, for each name, the rows whose key is in [key - width, key], of equal keys only those up to the row
    itself in id order (a null key counts the null keys so far); with `place` also the row's place, from 0, in the order
    (key, id). n: the number of rows, where the caller knows it.

    A count is the rows up to the row less those below key - width, both from running counts over distinct keys. Rows
    meet the figures of their key once a range, so a key that most rows share doesn't gather."""
    b, parts = ranges(df, by_key(key, row_id), n)
    per = b.groupBy(F.col(key).alias("_k"), "_b").agg(F.count("*").alias("_n"))
    per = stored(per, "keys")
    dense = per.groupBy("_k").agg(F.sum("_n").alias("_all"))
    asks = {f"_lo_{name}": (F.col("_k") - F.lit(float(width)), False) for name, width in widths.items()}
    counts = key_counts(dense, {"_cum": (F.col("_k"), True), **asks}, 1 if parts == 1 else None)
    figures = dense.join(counts, "_k", "left")
    figures = figures.select("_k", "_all", *[F.when(F.col("_k").isNull(), F.col("_all")).otherwise(F.col("_cum") - F.col(f"_lo_{name}")).alias(f"_w_{name}") for name in widths])
    if parts > 1:
        before = W.partitionBy("_k").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
        figures = meet(per.withColumn("_o", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n"), figures, ["_k"])
    else:
        figures = figures.withColumns({"_b": F.lit(0), "_o": F.lit(0)})
    rows = b.withColumn("_p", F.row_number().over(W.partitionBy(key, "_b").orderBy(row_id)))
    rows = meet(rows.withColumn("_k", F.col(key)), figures, ["_k", "_b"])
    rows = rows.withColumns({name: (F.col(f"_w_{name}") - F.col("_all") + F.col("_o") + F.col("_p")).cast("int") for name in widths})
    rows = rows.drop("_k", "_all", "_o", "_p", *[f"_w_{name}" for name in widths])
    if place:
        at = F.row_number().over(W.partitionBy("_b").orderBy(*by_key(key, row_id))) - 1
        rows = rows.withColumn(place, at.cast("long"))
        if parts > 1:
            sizes = per.groupBy("_b").agg(F.sum("_n").alias("_m"))
            starts = sizes.select("_b", F.coalesce(F.sum("_m").over(W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_o"))
            rows = meet(rows, starts, ["_b"], parts).withColumn(place, F.col(place) + F.col("_o")).drop("_o")
    return rows.drop("_b")


def trailing_count(df: DataFrame, key: str, row_id: str, width: float, out: str) -> DataFrame:
    """df with one trailing count; see trailing_counts()."""
    return trailing_counts(df, key, row_id, {out: width})


def around_count(df: DataFrame, key: str, width: float, out: str) -> DataFrame:
    """Rows whose key is within width / 2 of the row's, without itself; 0 for a null key."""
    half = F.lit(width / 2)
    dense = stored(df.groupBy(F.col(key).alias("_k")).agg(F.count("*").alias("_all")), "keys")
    counts = key_counts(dense, {"_hi": (F.col("_k") + half, True), "_lo": (F.col("_k") - half, False)})
    found = dense.join(counts, "_k", "left").select(F.col("_k").alias(key), "_all", (F.col("_hi") - F.col("_lo") - 1).alias("_w"))
    return meet_groups(df, found, [key], "_all").withColumn(out, F.coalesce("_w", F.lit(0)).cast("int")).drop("_w")


def as_of(left: DataFrame, right: DataFrame, left_key: str, right_key: str, right_id: str, values: list[str], strict: bool = False, within: list[str] | None = None) -> DataFrame:
    """left with the values of the last right row whose key is not above the left row's (below it, if strict); among
    equal keys the last by id. Only distinct keys are ordered, in ranges, and each range hands its last right row on;
    left rows then meet their key."""
    within = within or []
    side = (0, 1) if not strict else (1, 0)  # of equal keys the right one comes before the left one, or after
    r = right.where(F.col(right_key).isNotNull()).groupBy(*within, F.col(right_key).cast("double").alias("_k")).agg(F.max_by(F.struct(*values), right_id).alias("_val")).withColumn("_side", F.lit(side[0]))
    keys = left.groupBy(*within, F.col(left_key).cast("double").alias("_k")).agg(F.count("*").alias("_n"))
    a = keys.where("_k is not null").withColumns({"_val": F.lit(None).cast(r.schema["_val"].dataType), "_side": F.lit(side[1])})
    both, parts = ranges(r.withColumn("_n", F.lit(0).cast("long")).unionByName(a), [F.col("_k"), F.col("_side")], left.count() + right.count())
    seen = both.withColumn("_last", F.last("_val", ignorenulls=True).over(W.partitionBy(*within, "_b").orderBy("_k", "_side").rowsBetween(W.unboundedPreceding, 0)))
    if parts > 1:
        tails = both.groupBy(*within, "_b").agg(F.max_by("_val", F.when(F.col("_val").isNotNull(), F.col("_k"))).alias("_t"))
        carry = tails.withColumn("_carry", F.last("_t", ignorenulls=True).over(W.partitionBy(*within).orderBy("_b").rowsBetween(W.unboundedPreceding, -1))).drop("_t")
        seen = meet(seen, carry, [*within, "_b"], None if within else parts).withColumn("_last", F.coalesce("_last", "_carry"))
    found = seen.where(F.col("_side") == side[1]).select(*within, "_k", "_n", F.col("_last").alias("_v"))
    # null keys find nothing; as a group of their own they count like any other
    none = keys.where("_k is null").select(*within, "_k", "_n", F.lit(None).cast(found.schema["_v"].dataType).alias("_v"))
    out = meet_groups(left.withColumn("_k", F.col(left_key).cast("double")), found.unionByName(none), [*within, "_k"], "_n")
    return out.select(*left.columns, *[F.col(f"_v.{v}").alias(v) for v in values])
