"""Scores to inspection decisions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millwatch.operators import select
from millwatch.operators.ordering import global_index


def over_threshold(score: str, threshold: float, single: bool = True) -> Column:
    """1 where the score reaches the threshold; `single` compares a float score as float."""
    t = F.lit(threshold).cast("float") if single else F.lit(float(threshold))
    return F.coalesce((F.col(score) >= t).cast("int"), F.lit(0))


def budget_rows(n: Column, percent: float) -> Column:
    """ceil(n * percent / 100)."""
    return F.ceil(n * float(percent) / 100.0)


def in_budget(df: DataFrame, percent: float, score: str = "pred", row_id: str = "Id", batch: str | None = None, out: str = "_in") -> DataFrame:
    """df with `out`: the row is among the best ceil(n * percent / 100), highest score first, ties by id. Over all rows
    the cut is found by nested histograms, and no row is ordered; batches are ranked one by one."""
    if batch:
        w = W.partitionBy(batch)
        return df.withColumn(out, F.row_number().over(w.orderBy(F.desc(score), row_id)) <= budget_rows(F.count("*").over(w), percent))
    (cut,), _ = select.cuts(df, lambda n: [math.ceil(n * float(percent) / 100.0)], score, row_id)
    return df.withColumn(out, cut.holds(F.col(score), F.col(row_id)))


def top_budget(df: DataFrame, percent: float, score: str = "pred", batch: str | None = None, out: str = "inspect") -> DataFrame:
    return in_budget(df, percent, score, batch=batch).withColumn(out, F.col("_in").cast("int")).drop("_in")


def hybrid(df: DataFrame, threshold: float = 0.6, percent: float = 5.0, score: str = "pred", batch: str | None = None) -> DataFrame:
    """auto_reject, manual_inspect and decision (their or). Scores over the threshold are rejected; the next best go to
    inspection until the budget is used, which rejected rows lead."""
    if not 0 <= percent <= 100:
        raise ValueError("budget percent must be in [0, 100]")
    r = in_budget(df, percent, score, batch=batch).withColumn("auto_reject", over_threshold(score, threshold, single=False))
    r = r.withColumn("manual_inspect", ((F.col("auto_reject") == 0) & F.col("_in")).cast("int"))
    return r.withColumn("decision", F.greatest("auto_reject", "manual_inspect")).drop("_in")


def batches(df: DataFrame, size: int, row_id: str = "Id", out: str = "batch") -> DataFrame:
    """Positional batches in id order, with each row's position."""
    if size <= 0:
        raise ValueError("batch size must be positive")
    return global_index(df, row_id, row_id, "position").withColumn(out, F.expr(f"position div {size}"))
