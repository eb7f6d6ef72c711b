"""Joins with the checks that go with them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millwatch.operators.ordering import meet_groups
from millwatch.sources.io import stored


def one_to_one(left: DataFrame, right: DataFrame, on: str = "Id", check: bool = True) -> DataFrame:
    """Inner join on a key that is unique on both sides; with check, an action that raises on a repeated key."""
    if check:
        for name, side in (("left", left), ("right", right)):
            again = side.groupBy(on).count().where("count > 1").take(1)
            if again:
                raise ValueError(f"{on} repeats in the {name} input: {again[0][0]}")
    return left.join(right, on)


def all_to_one(tables: list[DataFrame], on: str = "Id") -> DataFrame:
    """Inner join of tables whose key is unique in each and whose other columns differ; raises on a repeated key. All
    tables meet in one shuffle, and the check reads the result."""
    line = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [t.withColumn("_t", F.lit(i)) for i, t in enumerate(tables)])
    rows = [F.count_if(F.col("_t") == i).alias(f"_t{i}") for i in range(len(tables))]
    cols = [F.max(F.when(F.col("_t") == i, F.col(c))).alias(c) for i, t in enumerate(tables) for c in t.columns if c != on]
    met = stored(line.where(F.col(on).isNotNull()).groupBy(on).agg(*rows, *cols), "met")
    again = met.where(F.greatest(*[F.col(f"_t{i}") for i in range(len(tables))], F.lit(0)) > 1).select(on).take(1)
    if again:
        raise ValueError(f"{on} repeats in an input: {again[0][0]}")
    return met.where(F.least(*[F.col(f"_t{i}") for i in range(len(tables))], F.lit(1)) == 1).drop(*[f"_t{i}" for i in range(len(tables))])


def left_filled(left: DataFrame, right: DataFrame, on: str, fills: dict[str, object]) -> DataFrame:
    out = left.join(right, on, "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in fills.items()})


def lookup(df: DataFrame, table: DataFrame, key: str, value: str, default: DataFrame, out: str) -> DataFrame:
    """df with `out`: the table's value for the key, else the one value of the one-row default. The table is broadcast
    when its size allows, else joined by a shuffle that sets heavy keys apart."""
    one = default.select(F.col(default.columns[0]).alias("_d"))
    met = meet_groups(df.withColumn("_k", F.col(key)), table.select(F.col(key).alias("_k"), F.col(value).alias("_v")), ["_k"])
    return met.crossJoin(F.broadcast(one)).withColumn(out, F.coalesce("_v", "_d")).drop("_k", "_v", "_d")
