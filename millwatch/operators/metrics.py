"""Confusion counts, curves over thresholds and budgets, decision tables and operating points."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millwatch.operators import encode, select

#: Cost of a missed failure and of a needless inspection.
COST_FN, COST_FP = 100.0, 5.0


def _d(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def ratio(a, b) -> Column:
    return F.coalesce(F.try_divide(_d(a), _d(b)), F.lit(0.0))


def counts(label: str = "Response", flag: str = "decision") -> list[Column]:
    y, f = F.col(label) == 1, F.col(flag) == 1
    return [F.count_if(y & f).alias("tp"), F.count_if(~y & f).alias("fp"), F.count_if(y & ~f).alias("fn"), F.count_if(~y & ~f).alias("tn")]


def rates(df: DataFrame) -> DataFrame:
    """precision, recall, flagged_pct from tp, fp, fn, tn; 0 where the denominator is."""
    return df.withColumns({"precision": ratio("tp", F.col("tp") + F.col("fp")), "recall": ratio("tp", F.col("tp") + F.col("fn")), "flagged_pct": 100 * ratio(F.col("tp") + F.col("fp"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))})


def mcc() -> Column:
    tp, fp, fn, tn = (_d(c) for c in ("tp", "fp", "fn", "tn"))
    den = (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)
    return F.when(den > 0, (tp * tn - fp * fn) / F.sqrt(den)).otherwise(0.0)


def confusion(df: DataFrame, label: str = "Response", flag: str = "decision", by: list[str] | None = None) -> DataFrame:
    return rates((df.groupBy(*by) if by else df).agg(*counts(label, flag))).withColumn("mcc", mcc())


def cost(fn_cost: float = COST_FN, fp_cost: float = COST_FP) -> Column:
    return _d("fn") * fn_cost + _d("fp") * fp_cost


def threshold_sweep(df: DataFrame, label: str = "Response", score: str = "pred", by: list[str] | None = None) -> DataFrame:
    """A row for each threshold 0.01 ... 0.99 (of each group). Rows become a histogram over the thresholds (a score's
    bucket is the number of thresholds not above it), and 99 suffix sums follow."""
    by = by or []
    grid = F.array(*[F.lit(k / 100) for k in range(1, 100)])
    guess = F.greatest(F.lit(0), F.least(F.lit(99), F.floor(F.col(score) * 100).cast("int")))
    low, high = F.greatest(guess - 1, F.lit(0)), F.least(guess + 1, F.lit(99))
    at = lambda k: F.coalesce(F.get(grid, k - 1), F.lit(float("-inf")))
    bucket = F.when(F.col(score) >= at(high), high).when(F.col(score) >= at(guess), guess).otherwise(low)
    h = df.where(F.col(score).isNotNull()).groupBy(*by, bucket.alias("k")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("q"))
    line = df.sparkSession.range(0, 100).select(F.col("id").cast("int").alias("k"))
    if by:
        line = h.select(*by).distinct().crossJoin(F.broadcast(line)).join(h, [*by, "k"], "left")
    else:
        line = line.join(F.broadcast(h), "k", "left")
    line = line.fillna(0, ["p", "q"])
    w, one = W.partitionBy(*by).orderBy(F.desc("k")).rowsBetween(W.unboundedPreceding, 0), W.partitionBy(*by)
    out = line.select(*by, "k", F.sum("p").over(w).alias("tp"), F.sum("q").over(w).alias("fp"), F.sum("p").over(one).alias("_p"), F.sum("q").over(one).alias("_q")).where("k > 0")
    out = out.select(*by, (F.col("k") / 100).alias("threshold"), "tp", "fp", (F.col("_p") - F.col("tp")).alias("fn"), (F.col("_q") - F.col("fp")).alias("tn"))
    return rates(out).withColumnRenamed("flagged_pct", "positives_pct").withColumn("mcc", mcc())


def best_threshold(sweep: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The threshold with the highest mcc, the lowest of several."""
    if not by:
        return sweep.orderBy(F.desc("mcc"), "threshold").limit(1)
    return sweep.withColumn("_r", F.row_number().over(W.partitionBy(*by).orderBy(F.desc("mcc"), "threshold"))).where("_r = 1").drop("_r")


def percent_rows(n: int, percent: float) -> int:
    """Rows of a budget in the budget curve, ceil(n * (percent / 100)); decisions take ceil(n * percent / 100)."""
    return math.ceil(n * (percent / 100))


def budget_curve(df: DataFrame, label: str = "Response", score: str = "pred", row_id: str = "Id", percents: tuple[int, ...] = tuple(range(1, 11))) -> DataFrame:
    """For each budget: rows selected, the score of the last, and their confusion. All budgets' cuts are found by nested
    histograms together; each row counts for the first cut it passes, and running sums over the budgets follow."""
    percents = tuple(sorted(percents))
    cuts, n = select.cuts(df, lambda rows: [percent_rows(rows, p) for p in percents], score, row_id)
    passed = F.coalesce(*[F.when(c.holds(F.col(score), F.col(row_id)), F.lit(j)) for j, c in enumerate(cuts)], F.lit(len(cuts)))
    h = df.groupBy(passed.alias("_j")).agg(F.count_if(F.col(label) == 1).alias("_p"), F.min(F.col(score).cast("double")).alias("_least"), F.count_if(F.col(score).isNull()).alias("_none"))
    least = {r["_j"]: (r["_p"], r["_least"], r["_none"]) for r in h.collect()}  # a row a budget
    rows, tp = [], 0
    for j, (p, c) in enumerate(zip(percents, cuts, strict=True)):
        got = least.get(j, (0, None, 0))
        tp += got[0]
        # where a cut lets all pass, the last row's score is the smallest there is
        last = c.score if c.score is not None else None if got[2] or c.nothing else got[1] if got[1] is not None else rows[-1][2] if rows else None
        rows.append((float(p), min(c.k, n), last, tp))
    pos = sum(v[0] for v in least.values())
    out = df.sparkSession.createDataFrame([(p, k, s, t, k - t, pos - t, n - pos - k + t) for p, k, s, t in rows], "inspection_budget_pct double, selected_rows long, score_cutoff double, tp long, fp long, fn long, tn long")
    return rates(out).drop("flagged_pct").withColumn("mcc", mcc())


def fixed_precision(sweep: DataFrame, targets: tuple[int, ...] = tuple(range(5, 55, 5))) -> DataFrame:
    """For each target precision the threshold with the best recall among those that reach it, else a row that says
    it is unavailable."""
    t = sweep.sparkSession.createDataFrame([(k / 100,) for k in targets], "target_precision double")
    j = F.broadcast(t).join(sweep, sweep["precision"] >= t["target_precision"], "left")
    best = j.withColumn("_r", F.row_number().over(W.partitionBy("target_precision").orderBy(F.desc_nulls_last("recall"), "threshold"))).where("_r = 1")
    return best.select("target_precision", F.col("threshold").isNotNull().alias("available"), "threshold", "precision", "recall", "mcc")


def risk_groups(df: DataFrame, label: str = "Response", score: str = "pred") -> DataFrame:
    """HIGH from the 90th percentile, MEDIUM from the 70th, LOW: parts, failure percent, mean score."""
    at = lambda share: F.max(F.when(F.col("share") == share, F.col("value")))
    q = encode.percentiles(df, [score], [0.9, 0.7]).agg(F.array(at(0.9), at(0.7)).alias("_q"))
    g = df.crossJoin(F.broadcast(q)).withColumn("risk_group", F.when(F.col(score) >= F.col("_q")[0], "HIGH").when(F.col(score) >= F.col("_q")[1], "MEDIUM").otherwise("LOW"))
    return g.groupBy("risk_group").agg(F.count("*").alias("parts"), (100 * F.avg(label)).alias("failure_pct"), F.avg(score).alias("mean_score"))


def decision_table(sweeps: dict[str, DataFrame], budgets: DataFrame, fn_cost: float = COST_FN, fp_cost: float = COST_FP) -> DataFrame:
    """All operating points with their costs: thresholds of each sweep, then budgets."""
    out = None
    for k, (name, s) in enumerate(sweeps.items()):
        rows = s.select(F.lit(name).alias("source"), F.lit("threshold").alias("mode"), F.format_string("thr=%.2f", "threshold").alias("configuration"), F.lit(None).cast("double").alias("inspection_budget_pct"), "threshold", "recall", "precision", "mcc", "tp", "fp", "fn", "tn", F.lit(k).alias("src_order"))
        out = rows if out is None else out.unionByName(rows)
    rows = budgets.select(F.lit("budget_curve").alias("source"), F.lit("budget").alias("mode"), F.format_string("budget=%d%%", F.col("inspection_budget_pct").cast("int")).alias("configuration"), "inspection_budget_pct", F.col("score_cutoff").alias("threshold"), "recall", "precision", "mcc", "tp", "fp", "fn", "tn", F.lit(len(sweeps)).alias("src_order"))
    out = rows if out is None else out.unionByName(rows)
    n = _d(F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))
    out = out.withColumns({"total_flagged_rows": F.col("tp") + F.col("fp"), "failures_caught": F.col("tp"), "failures_missed": F.col("fn"), "total_cost": cost(fn_cost, fp_cost)})
    return out.withColumn("cost_per_100k_rows", F.coalesce(F.try_divide("total_cost", n) * 100000, F.lit(0.0))).orderBy("total_cost", F.desc("recall"), "src_order", "threshold")


def operating_points(table: DataFrame) -> DataFrame:
    """Five named points: least cost; best recall with a budget up to 1, 5 and 10 percent; best balance."""
    spark = table.sparkSession
    cols = ["source", "configuration", "threshold", "recall", "precision", "mcc", "total_cost"]
    order = {"cost": [F.asc("total_cost"), F.desc("recall"), F.asc("src_order"), F.asc("threshold")], "recall": [F.desc("recall"), F.asc("total_cost"), F.asc("src_order"), F.asc("threshold")], "f1": [F.desc("_f1"), F.desc("mcc"), F.asc("src_order"), F.asc("threshold")]}
    scored = table.withColumn("_f1", 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + 1e-12))

    def top(rows: DataFrame, name: str, by: str) -> DataFrame:
        return rows.orderBy(*order[by]).limit(1).select(F.lit(name).alias("point"), *cols)

    found = top(scored, "min_cost", "cost").unionByName(top(scored, "best_f1", "f1"))
    for b in (1, 5, 10):
        found = found.unionByName(top(scored.where(F.col("inspection_budget_pct") <= b), f"best_recall_at_{b}pct", "recall"))
    names = spark.createDataFrame([(x,) for x in ("min_cost", "best_recall_at_1pct", "best_recall_at_5pct", "best_recall_at_10pct", "best_f1")], "point string")
    return names.join(found, "point", "left").withColumn("available", F.col("source").isNotNull())


def segments(df: DataFrame, threshold: float, label: str = "Response", score: str = "pred") -> DataFrame:
    """Missed and caught failures at a threshold: count and mean score, 0 if there are none."""
    hit = F.col(score) >= threshold
    one = df.where(F.col(label) == 1).agg(*[x for n, c in (("FN", ~hit), ("TP", hit)) for x in (F.count_if(c).alias(f"{n}_n"), F.coalesce(F.avg(F.when(c, F.col(score))), F.lit(0.0)).alias(f"{n}_m"))])
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("segment"), F.col(f"{n}_n").alias("parts"), F.col(f"{n}_m").alias("mean_score")) for n in ("FN", "TP")])).alias("s")).select("s.*")


def histogram(df: DataFrame, bins: int = 100, score: str = "pred", by: list[str] | None = None) -> DataFrame:
    """Rows in each of `bins` equal parts of [least, greatest]."""
    edge = df.agg(F.min(score).alias("_lo"), F.max(score).alias("_hi"))
    k = F.least(F.floor((F.col(score) - F.col("_lo")) * bins / (F.col("_hi") - F.col("_lo"))), F.lit(bins - 1))
    return df.crossJoin(F.broadcast(edge)).groupBy(*(by or []), F.coalesce(k, F.lit(0)).cast("int").alias("bin")).agg(F.count("*").alias("parts"))


def best_source(sources: dict[str, DataFrame], threshold: float = 0.74) -> DataFrame:
    """The rows of the source with the highest mcc at the threshold; the first of several."""
    if not sources:
        raise ValueError("no source of scores")
    out = None
    for k, (name, df) in enumerate(sources.items()):
        rows = df.select("Id", "Response", "pred", F.lit(name).alias("source"), F.lit(k).alias("_k"))
        out = rows if out is None else out.unionByName(rows)
    flagged = out.withColumn("decision", (F.col("pred") >= threshold).cast("int"))
    best = confusion(flagged, by=["source", "_k"]).orderBy(F.desc("mcc"), "_k").limit(1).select(F.col("source").alias("_s"), "mcc")
    return out.join(F.broadcast(best), F.col("source") == F.col("_s")).select("Id", "Response", "pred", "source", "mcc")
