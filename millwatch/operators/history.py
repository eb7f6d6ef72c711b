"""What happened before a row: records around it, failures since, rates of the rows before it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millwatch.operators.ordering import as_of, by_key, global_index, meet_groups, running
from millwatch.sources.io import stored


def records_around(df: DataFrame, row_id: str = "Id", widths: tuple[int, ...] = (25, 240, 1680), rows: int | None = None) -> DataFrame:
    """records_before_<w> and records_after_<w> in id order: at most w, the row itself counted. rows: their number, where df
    is a stored table of which the caller knows it."""
    n = df.agg(F.count("*").alias("_n"))
    i = global_index(df, row_id, row_id, "_i", n=rows).crossJoin(F.broadcast(n))
    for w in widths:
        i = i.withColumns({f"records_before_{w}": F.least(F.col("_i") + 1, F.lit(w)), f"records_after_{w}": F.least(F.col("_n") - F.col("_i"), F.lit(w))})
    return i.drop("_i", "_n")


def trailing_rate(df: DataFrame, key: str, row_id: str, target: str, rows: int, out: str, within: list[str] | None = None) -> DataFrame:
    """df with the mean target of the `rows` rows before the row in the order (key, id); the first gets null.

    Sums up to a row come from prefix sums; the sum up to the frame's begin is that of another row, found by its place,
    so no wide frame is held."""
    within = within or []
    s = stored(running(df, by_key(key, row_id), {"_s": F.col(target).cast("long"), "_i": F.lit(1).cast("long")}, within, inclusive=False), "places")
    back = s.select(*[F.col(c).alias(f"_w_{c}") for c in within], (F.col("_i") + rows).alias("_j"), F.col("_s").alias("_s0"))
    cond = F.col("_i") == F.col("_j")
    for c in within:
        cond = cond & F.col(c).eqNullSafe(F.col(f"_w_{c}"))
    j = s.join(back, cond, "left")
    n = F.least(F.col("_i"), F.lit(rows))
    return j.withColumn(out, F.try_divide((F.col("_s") - F.coalesce("_s0", F.lit(0))).cast("double"), n.cast("double"))).drop("_s", "_i", "_j", "_s0", *[f"_w_{c}" for c in within])


def oof_trailing_rate(df: DataFrame, key: str = "start_time", row_id: str = "Id", fold: str = "cv_fold", target: str = "Response", rows: int = 10000, out: str = "rolling_fail_rate") -> DataFrame:
    """For each row the trailing rate at the last row of the other folds not after it; the overall mean where there is
    none. A null key sorts before all (-1e9).

    One order serves all folds: running sums hold, for each fold, the rows of the others so far and their targets, so a
    row's frame is the sum at its own rank less the sum `rows` ranks before, both found by rank in its range. A range
    also gets the last rows of those before it, as far as its frames reach back (mostly the end of one). Rows then meet
    the figures of their key's last row."""
    d = df.withColumn("_k", F.coalesce(F.col(key).cast("double"), F.lit(-1e9)))
    mean = df.agg(F.avg(target).alias("_g"))
    folds = sorted(r[0] for r in df.select(fold).distinct().collect() if r[0] is not None)  # a few
    js, other = range(len(folds)), [F.coalesce(F.col(fold) != f, F.lit(False)) for f in folds]
    sums = {f"_n{j}": o.cast("long") for j, o in enumerate(other)} | {f"_s{j}": F.when(o, F.col(target)).otherwise(0).cast("long") for j, o in enumerate(other)}
    run = stored(running(d.select("_k", row_id, fold, target), by_key("_k", row_id), sums, keep=True).drop(fold, target), "sums")
    ends = run.groupBy("_b").agg(*[f(f"_n{j}").alias(f"_{e}{j}") for j in js for e, f in (("lo", F.min), ("hi", F.max))])
    ends = stored(ends.withColumn("_at", F.row_number().over(W.orderBy("_b"))), "ends")
    back = lambda n, lo: reduce(lambda x, y: x | y, [F.col(f"{n}{j}") >= F.col(f"{lo}{j}") - rows - 1 for j in js], F.lit(False))
    # (a range, a later one that reaches back into it); each step goes one range further
    pairs, step = [], 1
    while True:
        later = ends.select((F.col("_at") - step).alias("_at"), F.col("_b").alias("_to"), *[F.col(f"_lo{j}").alias(f"_f{j}") for j in js])
        near = stored(ends.join(later, "_at").where(back("_hi", "_f")).select("_b", "_to", *[f"_f{j}" for j in js]), "near")
        if not near.take(1):
            break
        pairs.append(near)
        step += 1
    line = run
    if pairs:
        halo = run.join(F.broadcast(reduce(DataFrame.unionByName, pairs)), "_b").where(back("_n", "_f")).withColumn("_b", F.col("_to"))
        line = run.withColumn("_own", F.lit(True)).unionByName(halo.select(*run.columns, F.lit(False).alias("_own")))
    rates = []
    for j in js:
        at = lambda ranks, j=j: F.coalesce(F.max(f"_s{j}").over(W.partitionBy("_b").orderBy(f"_n{j}").rangeBetween(-ranks, -ranks)), F.lit(0))
        line = line.withColumns({f"_x{j}": at(1), f"_y{j}": at(rows + 1)})
        n = F.col(f"_n{j}") - 1
        rates.append(F.when(n > 0, F.try_divide((F.col(f"_x{j}") - F.col(f"_y{j}")).cast("double"), F.least(n, F.lit(rows)).cast("double"))))
    line = line.where("_own") if pairs else line
    per = line.groupBy("_k").agg(F.max_by(F.array(*rates).cast("array<double>"), row_id).alias("_rates"), F.count("*").alias("_c"))
    mine = F.array_position(F.array(*[F.lit(f) for f in folds]), F.col(fold)).cast("int") - 1 if folds else F.lit(None).cast("int")
    got = meet_groups(d, per, ["_k"], "_c").withColumn("_rate", F.when(mine >= 0, F.get("_rates", mine)))
    return got.crossJoin(F.broadcast(mean)).withColumn(out, F.coalesce("_rate", "_g")).drop("_k", "_rate", "_rates", "_g")


def since_failures(df: DataFrame, failures: DataFrame, key: str, failure_key: str, failure_id: str, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """since_last_<k>: the row's time less the mean time of the last k failures strictly before it; null with fewer."""
    f = failures.where(F.col(failure_key).isNotNull()).select(F.col(failure_key).cast("double").alias("_ft"), F.col(failure_id).alias("_fi"))
    f = global_index(f, "_ft", "_fi", "_at")
    # each failure counts for itself and the next ones
    wide = f.select("*", F.explode(F.sequence(F.lit(0), F.lit(max(ks) - 1))).alias("_step"))
    own = F.col("_step") == 0
    means = [F.when(F.count(F.when(F.col("_step") < k, 1)) == k, F.sum(F.when(F.col("_step") < k, F.col("_ft"))) / k).alias(f"_m{k}") for k in ks]
    f = wide.groupBy((F.col("_at") + F.col("_step")).alias("_to")).agg(F.max(F.when(own, F.col("_ft"))).alias("_ft"), F.max(F.when(own, F.col("_fi"))).alias("_fi"), *means).where("_ft is not null")
    f = stored(f, "failures")
    got = as_of(df, f, key, "_ft", "_fi", [f"_m{k}" for k in ks], strict=True)
    return got.withColumns({f"since_last_{k}": F.col(key) - F.col(f"_m{k}") for k in ks}).drop(*[f"_m{k}" for k in ks])
