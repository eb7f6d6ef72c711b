"""The registered queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millwatch.operators import decide, metrics
from millwatch.plans import fixtures, q_models, q_rows, q_stats, q_windows, registry  # noqa: F401


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid decisions (threshold 0.6, budget 5 percent) to confusion, mcc and cost."""
    d = decide.hybrid(fixtures.scores(spark, sf_dir), 0.6, 5.0)
    out = metrics.confusion(d)
    return out.withColumn("total_cost", metrics.cost()).withColumn("mcc", F.round("mcc", 9))


def queries() -> dict:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.SQL)
