"""Drift between a reference and a current sample."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millwatch.operators.ordering import meet, running
from millwatch.sources.io import stored

#: From so many reference rows distances are used, with their threshold; below, p-values with theirs.
LARGE, DISTANCE, P_VALUE = 1000, 0.1, 0.05
#: Numbers with so many values at most are taken as categories.
FEW_VALUES = 5


def stable_split(df: DataFrame, row_id: str = "Id", share: float = 0.7, seed: int = 42) -> DataFrame:
    """df with is_reference: the first floor(share * n) rows by a hash of id and seed."""
    n = df.agg(F.count("*").alias("_n"))
    h = df.withColumn("_h", F.md5(F.concat(F.col(row_id).cast("string"), F.lit(f":{seed}"))))
    placed = running(h, [F.col("_h").asc(), F.col(row_id).asc()], {"_i": F.lit(1).cast("long")}, inclusive=False)
    return placed.crossJoin(F.broadcast(n)).withColumn("is_reference", F.col("_i") < F.floor(F.col("_n") * share)).drop("_h", "_i", "_n")


def _fractions(ref: DataFrame, cur: DataFrame, cols: list[str]) -> DataFrame:
    """(column, x, f, g, next, n, m): for each column the cumulative shares of both samples at each distinct value, the
    next value, and the rows with one. All columns go through one ordered pass."""

    def long(df: DataFrame, a: int) -> DataFrame:
        xs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in cols]))
        return df.select(xs.alias("p")).select("p.*", F.lit(a).cast("long").alias("a"), F.lit(1 - a).cast("long").alias("b"))

    per = long(ref, 1).unionByName(long(cur, 0)).where(F.col("x").isNotNull() & ~F.isnan("x")).groupBy("column", "x").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    run = running(stored(per, "values"), [F.col("x").asc()], {"f": F.col("a"), "g": F.col("b")}, ["column"], totals=True, keep=True)
    run = run.withColumn("next", F.lead("x").over(W.partitionBy("column", "_b").orderBy("x")))
    firsts = run.groupBy("column", "_b").agg(F.min("x").alias("_x"))
    after = firsts.select("column", "_b", F.lead("_x").over(W.partitionBy("column").orderBy("_b")).alias("_after"))
    run = meet(run, after, ["column", "_b"])
    return run.select("column", "x", (F.col("f") / F.col("f_total")).alias("f"), (F.col("g") / F.col("g_total")).alias("g"), F.coalesce("next", "_after").alias("next"), F.col("f_total").alias("n"), F.col("g_total").alias("m"))


def wasserstein(ref: DataFrame, cur: DataFrame, cols: list[str], floor: float = 0.001) -> DataFrame:
    """(column, drift_score): Wasserstein-1 distance over the reference's deviation (floored)."""
    sd = ref.agg(*[F.greatest(F.stddev_pop(c), F.lit(floor)).alias(c) for c in cols])
    sd = sd.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("_sd")) for c in cols])).alias("p")).select("p.*")
    d = _fractions(ref, cur, cols).groupBy("column").agg(F.sum(F.abs(F.col("f") - F.col("g")) * (F.col("next") - F.col("x"))).alias("_d"))
    return F.broadcast(sd).join(d, "column", "left").select("column", (F.coalesce("_d", F.lit(0.0)) / F.col("_sd")).alias("drift_score"))


def jensen_shannon(ref: DataFrame, cur: DataFrame, col: str) -> DataFrame:
    """(column, drift_score): the square root of the divergence, in natural logarithms."""
    both = ref.select(F.col(col).cast("string").alias("v"), F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(cur.select(F.col(col).cast("string").alias("v"), F.lit(0).alias("a"), F.lit(1).alias("b")))
    per = both.groupBy("v").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    total = per.agg(F.sum("a").alias("_na"), F.sum("b").alias("_nb"))
    p, q = F.col("a") / F.col("_na"), F.col("b") / F.col("_nb")
    m = (p + q) / 2
    term = lambda x: F.when(x > 0, x * F.log(x / m)).otherwise(0.0)
    return per.crossJoin(F.broadcast(total)).agg((F.sum(term(p) + term(q)) / 2).alias("_d")).select(F.lit(col).alias("column"), F.sqrt(F.greatest("_d", F.lit(0.0))).alias("drift_score"))


def kolmogorov_smirnov(ref: DataFrame, cur: DataFrame, cols: list[str], terms: int = 100) -> DataFrame:
    """(column, statistic, p_value): the largest gap of the cumulative shares, and its asymptotic p-value."""
    d = _fractions(ref, cur, cols).groupBy("column").agg(F.max(F.abs(F.col("f") - F.col("g"))).alias("statistic"), F.max("n").alias("_n"), F.max("m").alias("_m"))
    lam = F.sqrt(F.col("_n") * F.col("_m") / (F.col("_n") + F.col("_m"))) * F.col("statistic")
    series = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), F.lit(0.0), lambda a, k: a + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2 * k * k * lam * lam))
    return d.select("column", "statistic", F.when(lam < 0.2, 1.0).otherwise(F.least(F.greatest(series, F.lit(0.0)), F.lit(1.0))).alias("p_value"))


def drifted(score: Column, threshold: Column, is_p_value: Column) -> Column:
    return F.when(is_p_value, score < threshold).otherwise(score > threshold)


def rule(scores: DataFrame, threshold: float = DISTANCE, is_p_value: bool = False) -> DataFrame:
    """(column, drift_score, threshold, drift_detected)."""
    t = F.lit(threshold)
    return scores.select("column", "drift_score", t.alias("threshold"), F.coalesce(drifted(F.col("drift_score"), t, F.lit(is_p_value)), F.lit(False)).alias("drift_detected"))


def chi_square_survival(x: float, k: int) -> float:
    """The share of the chi-square distribution with k degrees of freedom above x: by its recursion from one degree (erfc)
    or two (exp), two degrees a step."""
    if k <= 0 or x <= 0:
        return 1.0
    if math.isinf(x):
        return 0.0
    y = x / 2
    a, q = (0.5, math.erfc(math.sqrt(y))) if k % 2 else (1.0, math.exp(-y))
    while a < k / 2:
        q += math.exp(a * math.log(y) - y - math.lgamma(a + 1))
        a += 1
    return min(1.0, q)


def category_tests(ref: DataFrame, cur: DataFrame, cols: list[str]) -> DataFrame:
    """(column, test, statistic, p_value) of categories, nulls left out. Up to two values: z_test, the two-sided test that
    both samples have the same share of a value, the statistic being z squared; more: chi_square of the current counts
    against the reference's shares, infinite where a value is new. Values are counted by column in one pass; a column's
    sums are one row, from which the driver takes the p-value."""

    def long(df: DataFrame, a: int) -> DataFrame:
        vs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in cols]))
        return df.select(vs.alias("p")).select("p.*", F.lit(a).cast("long").alias("a"), F.lit(1 - a).cast("long").alias("b"))

    per = long(ref, 1).unionByName(long(cur, 0)).where("v is not null").groupBy("column", "v").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    per = stored(per, "categories")
    total = per.groupBy("column").agg(F.sum("a").alias("n"), F.sum("b").alias("m"))
    expected = F.col("a") * F.col("m") / F.col("n")
    part = F.when(F.col("a") > 0, (F.col("b") - expected) * (F.col("b") - expected) / expected).when(F.col("b") > 0, F.lit(float("inf"))).otherwise(0.0)
    share = (F.col("a") + F.col("b")) / (F.col("n") + F.col("m"))
    gap = F.col("a") / F.col("n") - F.col("b") / F.col("m")
    z = F.try_divide(gap * gap, share * (1 - share) * (1 / F.col("n") + 1 / F.col("m")))
    sums = per.join(F.broadcast(total.where("n > 0 and m > 0")), "column").groupBy("column").agg(F.count("*").alias("k"), F.sum(part).alias("chi"), F.max(z).alias("z"))
    rows = []
    for r in sums.collect():  # a row a column
        two = r["k"] <= 2
        x = float((r["z"] or 0.0) if two else r["chi"])
        rows.append((r["column"], "z_test" if two else "chi_square", x, chi_square_survival(x, 1 if two else r["k"] - 1)))
    return ref.sparkSession.createDataFrame(rows, "column string, test string, statistic double, p_value double")


def detect(ref: DataFrame, cur: DataFrame, numeric: list[str], categorical: list[str] = ()) -> DataFrame:
    """(column, test, drift_score, threshold, drift_detected) with the test that fits the reference's size and the column's
    kind: above `LARGE` rows distances (Wasserstein for numbers, Jensen-Shannon for categories), else p-values
    (Kolmogorov-Smirnov for numbers; chi-square, or the z test for two values, for categories). Numbers with `FEW_VALUES`
    values or fewer in the reference count as categories."""
    large = ref.limit(LARGE + 1).count() > LARGE
    numeric, categorical = list(numeric), list(categorical)
    if numeric:
        kinds = ref.agg(*[F.approx_count_distinct(c, 0.01).alias(c) for c in numeric]).first()
        few = [c for c in numeric if kinds[c] <= FEW_VALUES]
        numeric, categorical = [c for c in numeric if c not in few], [*categorical, *few]
    out = []
    if categorical and large:
        out += [rule(jensen_shannon(ref, cur, c)).withColumn("test", F.lit("jensen_shannon")) for c in categorical]
    elif categorical:
        tests = stored(category_tests(ref, cur, categorical), "tests")
        out.append(rule(tests.select("column", F.col("p_value").alias("drift_score")), P_VALUE, is_p_value=True).join(tests.select("column", "test"), "column"))
    if numeric and large:
        out.append(rule(wasserstein(ref, cur, numeric)).withColumn("test", F.lit("wasserstein")))
    elif numeric:
        p = kolmogorov_smirnov(ref, cur, numeric).select("column", F.col("p_value").alias("drift_score"))
        out.append(rule(p, P_VALUE, is_p_value=True).withColumn("test", F.lit("kolmogorov_smirnov")))
    return reduce(lambda x, y: x.unionByName(y), out).select("column", "test", "drift_score", "threshold", "drift_detected")


def summary(rows: DataFrame, prediction: str = "pred") -> DataFrame:
    """One row: drifted columns, columns, their share, the prediction's own result, and the drifted columns by score."""
    one = rows.agg(F.count_if("drift_detected").alias("drifted_columns_count"), F.count("*").alias("number_of_columns"), F.max(F.when(F.col("column") == prediction, F.struct("drift_detected", "drift_score", "threshold"))).alias("_p"), F.sort_array(F.collect_list(F.when(F.col("drift_detected"), F.struct((-F.col("drift_score")).alias("s"), "column")))).alias("_d"))
    return one.select("drifted_columns_count", "number_of_columns", F.coalesce(F.try_divide(F.col("drifted_columns_count").cast("double"), F.col("number_of_columns").cast("double")), F.lit(0.0)).alias("drift_share"), F.col("_p.drift_detected").alias("prediction_drift"), F.col("_p.drift_score").alias("prediction_score"), F.array_join(F.transform("_d", lambda x: x["column"]), ",").alias("drifted_columns"))
