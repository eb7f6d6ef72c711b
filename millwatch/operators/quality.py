"""Checks of results, as rows (module, check, passed)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHECK = "module string, check string, passed boolean"


def no_nulls(df: DataFrame, module: str) -> DataFrame:
    """Whether no numeric column holds null or NaN, in one aggregation."""
    cols = [c for c, t in df.dtypes if t in ("double", "float", "int", "bigint", "smallint", "tinyint") or t.startswith("decimal")]
    bad = reduce(lambda a, b: a + b, [F.count_if(F.col(c).isNull() | F.isnan(F.col(c).cast("double"))) for c in cols], F.lit(0))
    return df.agg(bad.alias("b")).select(F.lit(module).alias("module"), F.lit("no_nulls").alias("check"), (F.col("b") == 0).alias("passed"))


def in_range(df: DataFrame, module: str, ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """Whether each named column is there and within its bounds."""
    checks = []
    for c, (lo, hi) in ranges.items():
        ok = F.coalesce(F.bool_and(F.coalesce(F.col(c).between(lo, hi), F.lit(False))), F.lit(False)) if c in df.columns else F.bool_and(F.lit(False))
        checks.append(F.struct(F.lit(module).alias("module"), F.lit(f"{c}_in_range").alias("check"), F.coalesce(ok, F.lit(False)).alias("passed")))
    return df.agg(F.array(*checks).alias("c")).select(F.explode("c").alias("c")).select("c.*")


def not_empty(df: DataFrame, module: str) -> DataFrame:
    return df.agg(F.count("*").alias("n")).select(F.lit(module).alias("module"), F.lit("not_empty").alias("check"), (F.col("n") > 0).alias("passed"))


def recall_consistent(points: DataFrame, replay: DataFrame, slack: float = 0.25) -> DataFrame:
    """Whether the replay's mean recall is not below the least-cost point's by more than the slack."""
    a = points.where("point = 'min_cost'").select(F.col("recall").alias("_a"))
    b = replay.select(F.col("recall_mean").alias("_b"))
    return a.crossJoin(b).select(F.lit("cross").alias("module"), F.lit("replay_recall").alias("check"), (F.col("_b") >= F.col("_a") - slack).alias("passed"))


def overall(checks: DataFrame) -> DataFrame:
    return checks.agg(F.coalesce(F.bool_and("passed"), F.lit(False)).alias("passed"), F.count("*").alias("checks"), F.count_if(~F.col("passed")).alias("failed"))
