"""Adjacent duplicate runs and features of a run's rows. No run and no group of equal rows is ordered in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millwatch.functions import numbers as N
from millwatch.operators.ordering import are_light, by_key, meet, meet_groups, ranges, running
from millwatch.sources.io import stored

#: Rows without data are spread over so many groups, where they would meet in one.
SPREAD = 1024


def adjacent_runs(df: DataFrame, keys: list[str], start: str = "start_time", row_id: str = "Id", rows: int | None = None, keep: bool = True) -> DataFrame:
    """is_duplicate, run_id (from 1), run_size, run_rank, run_rank_desc in the order (start, id), nulls last: a run is a
    stretch of rows with equal keys, nulls being equal. A row knows where its run begins from the rows before it and
    where the next one begins from the rows after it, both by frames that grow (forwards and backwards) in its range;
    each range hands on its rows and runs so far, where its last run began and where its first new one does. Ranks and
    sizes are differences of places, so a run of any length is neither a group nor a frame. Rows equal in start and id
    take any order; an empty table gives none. rows: their number, where df is a stored table of which the caller knows it. Without
    keep the keys leave when runs are known."""
    key, order = F.struct(*keys), by_key(start, row_id)
    b, parts = ranges(df, order, rows)
    w = W.partitionBy("_b").orderBy(*order)
    j = b.withColumns({"_prev": F.lag(key).over(w), "_i": F.row_number().over(w).cast("long")})
    same = (F.col("_i") > 1) & F.col("_prev").eqNullSafe(key)
    if parts > 1:
        j = stored(j.withColumn("_same", same).drop("_prev"), "places")
        per = j.groupBy("_b").agg(F.count("*").alias("_n")).withColumn("_at", F.row_number().over(W.orderBy("_b")))
        # each range's first row meets the last one of the range before it: whole keys, two rows a range
        edge = lambda row, step, name: meet(row.select("_b", key.alias(name)), per, ["_b"], parts).select((F.col("_at") + step).alias("_at"), name, *(["_b"] if step == 0 else []))
        ends = meet(j, per.select("_b", F.col("_n").alias("_end")), ["_b"], parts).where("_i = _end")
        goes_on = edge(j.where("_i = 1"), 0, "_first").join(edge(ends, 1, "_last"), "_at").select("_b", F.col("_first").eqNullSafe(F.col("_last")).alias("_on"))
        j = meet(j, goes_on, ["_b"], parts)
        same = F.when(F.col("_i") == 1, F.coalesce("_on", F.lit(False))).otherwise(F.col("_same"))
    j = j.withColumn("is_duplicate", same.cast("int")).drop("_prev", "_same", "_on", *([] if keep else keys))
    j = j.withColumn("_new", F.when(F.col("is_duplicate") == 0, F.col("_i")))
    upto = W.partitionBy("_b").orderBy("_i").rowsBetween(W.unboundedPreceding, 0)
    after = W.partitionBy("_b").orderBy(F.desc("_i")).rowsBetween(W.unboundedPreceding, -1)
    j = j.withColumns({"run_id": F.count("_new").over(upto), "_from": F.max("_new").over(upto)}).withColumn("_next", F.min("_new").over(after))
    if parts > 1:
        j = stored(j, "runs")
        per = j.groupBy("_b").agg(F.count("*").alias("_n"), F.count("_new").alias("_c"), F.max("_new").alias("_l"), F.min("_new").alias("_f"))
        past, later = W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1), W.orderBy(F.desc("_b")).rowsBetween(W.unboundedPreceding, -1)
        per = per.withColumns({"_o": F.coalesce(F.sum("_n").over(past), F.lit(0)), "_oc": F.coalesce(F.sum("_c").over(past), F.lit(0)), "_end": F.sum("_n").over(W.partitionBy()) + 1})
        per = per.withColumns({"_l": F.col("_l") + F.col("_o"), "_f": F.col("_f") + F.col("_o")})
        per = per.withColumn("_pl", F.last("_l", ignorenulls=True).over(past)).withColumn("_nf", F.last("_f", ignorenulls=True).over(later)).drop("_n", "_c", "_l", "_f")
        j = meet(j, per, ["_b"], parts)
    else:
        j = j.withColumns({"_o": F.lit(0), "_oc": F.lit(0), "_pl": F.lit(None).cast("long"), "_nf": F.lit(None).cast("long"), "_end": F.count("*").over(W.partitionBy("_b")) + 1})
    begin = F.coalesce(F.col("_from") + F.col("_o"), F.col("_pl"))
    j = j.withColumns({"run_id": F.col("run_id") + F.col("_oc"), "run_size": F.coalesce(F.col("_next") + F.col("_o"), F.col("_nf"), F.col("_end")) - begin, "run_rank": (F.col("_i") + F.col("_o") - begin + 1).cast("int")})
    return j.withColumn("run_rank_desc", F.col("run_size") - F.col("run_rank") + 1).drop("_b", "_i", "_from", "_next", "_new", "_o", "_oc", "_pl", "_nf", "_end")


def _spread(cols: list[Column], row_id: str) -> tuple[Column, Column]:
    """Whether a row has data, and a group for rows that have none."""
    has = F.coalesce(*cols).isNotNull()
    return has, F.when(~has, F.pmod(F.xxhash64(row_id), F.lit(SPREAD)))


def station_duplicates(df: DataFrame, stations: dict[str, list[str]], start: str = "start_time", row_id: str = "Id", at_hand: bool = False) -> DataFrame:
    """<station>_dup_count and <station>_dup_rank of rows with equal measures there, 0 without any; and their total. at_hand:
    df is a stored table."""
    base = df = df if at_hand else stored(df, "unordered")
    for s, cols in stations.items():
        has, group = _spread([F.col(c) for c in cols], row_id)
        d, within = df.withColumn("_z", group), [*cols, "_z"]
        if are_light(base.withColumn("_z", group), within):
            w = W.partitionBy(*within)
            d = d.withColumns({"_r": F.row_number().over(w.orderBy(*by_key(start, row_id))), "_r_total": F.count("*").over(w)})
        else:
            d = running(d, by_key(start, row_id), {"_r": F.lit(1).cast("long")}, within, totals=True)
        df = d.withColumns({f"{s}_dup_count": F.when(has, F.col("_r_total")).otherwise(0).cast("int"), f"{s}_dup_rank": F.when(has, F.col("_r")).otherwise(0).cast("int")}).drop("_z", "_r", "_r_total")
    return df.withColumn("total_station_dups", N.add([F.lit(0), *[F.col(f"{s}_dup_count") for s in stations]]))


def rounded_duplicates(df: DataFrame, stations: dict[str, list[str]], least: float = 0.01, digits: int = 6, row_id: str = "Id") -> DataFrame:
    """<station>_concat_count of rows with equal rounded measures, where enough of them are distinct, and the sum of
    their log1p."""
    from millwatch.operators.encode import uniqueness_gate

    base = df
    for s, cols in stations.items():
        gate = uniqueness_gate(base, cols, least, digits).select(F.col("use_counts").alias("_use"))
        has, group = _spread([F.col(c) for c in cols], row_id)
        keys = {f"_q{i}": F.bround(F.col(c), digits) for i, c in enumerate(cols)}
        rows = df.withColumns(keys | {"_z": group})
        per = base.withColumns(keys | {"_z": group}).where("_z is null").groupBy(*keys, "_z").agg(F.count("*").alias("_n"))
        df = meet(rows, per, [*keys, "_z"]).crossJoin(F.broadcast(gate)).withColumn(f"{s}_concat_count", F.when(has & F.col("_use"), F.col("_n")).otherwise(0).cast("int")).drop("_use", "_n", "_z", *keys)
    return df.withColumn("total_concat_count", N.add([F.lit(0.0), *[F.log1p(F.col(f"{s}_concat_count").cast("double")) for s in stations]]))


def neighbours(df: DataFrame, cols: list[str]) -> DataFrame:
    """Of each column the run's previous and next value (-1 if missing), whether they are missing, and the deltas. The
    neighbour is found by its rank in the run."""
    at = lambda step, name: df.select(F.col("run_id").alias("_g"), (F.col("run_rank") + step).alias("_p"), *[F.col(c).alias(f"{c}_{name}") for c in cols])
    out = df
    for step, name in ((1, "prev"), (-1, "next")):
        o = at(step, name)
        out = out.join(o, (out["run_id"] == o["_g"]) & (out["run_rank"] == o["_p"]), "left").drop("_g", "_p")
    for c in cols:
        out = out.withColumns({f"{c}_prev_missing": F.col(f"{c}_prev").isNull().cast("int"), f"{c}_next_missing": F.col(f"{c}_next").isNull().cast("int"), f"{c}_prev": F.coalesce(f"{c}_prev", F.lit(-1.0)), f"{c}_next": F.coalesce(f"{c}_next", F.lit(-1.0))})
        out = out.withColumns({f"{c}_delta_prev": F.col(c) - F.col(f"{c}_prev"), f"{c}_delta_next": F.col(f"{c}_next") - F.col(c)})
    return out


def expanding_mean(df: DataFrame, score: str, out: str = "prev_score_mean") -> DataFrame:
    """Mean score of the run's rows before the row; 0 for the first."""
    d = running(df, by_key("run_rank", "Id"), {"_s": F.col(score), "_n": F.col(score).isNotNull().cast("long")}, ["run_id"], inclusive=False)
    return d.withColumn(out, F.coalesce(F.try_divide("_s", "_n"), F.lit(0.0))).drop("_s", "_n")


def run_statistics(df: DataFrame, score: str, duration: str = "duration") -> DataFrame:
    """df with its run's mean, maximum and deviation of scores and mean and range of durations; long runs meet theirs
    apart, so a run is no task."""
    per = df.groupBy("run_id").agg(F.count("*").alias("_n"), F.avg(score).alias("run_score_mean"), F.max(score).alias("run_score_max"), F.coalesce(F.stddev_samp(score), F.lit(0.0)).alias("run_score_std"), F.avg(duration).alias("run_duration_mean"), (F.max(duration) - F.min(duration)).alias("run_duration_range"))
    return meet_groups(df, per, ["run_id"], "_n")


def run_rank_of(df: DataFrame, col: str, out: str) -> DataFrame:
    """The row's rank in its run, highest first, ties by run_rank."""
    order = [F.col(col).desc_nulls_last(), F.col("run_rank").asc(), F.col("Id").asc()]
    return running(df, order, {out: F.lit(1).cast("long")}, ["run_id"]).withColumn(out, F.col(out).cast("int"))


def positions(df: DataFrame) -> DataFrame:
    n, r = F.col("run_size"), F.col("run_rank")
    return df.withColumns({"position": r, "position_from_end": F.col("run_rank_desc"), "position_ratio": F.when(n > 1, (r - 1) / (n - 1)).otherwise(0.0), "is_run_start": (r == 1).cast("int"), "is_run_end": (F.col("run_rank_desc") == 1).cast("int")})
