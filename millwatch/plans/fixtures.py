"""Inputs of the registered queries, made from the given tables, in Spark and as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STATIONS = [f"L{(k - 1) % 4}_S{k}" for k in range(1, 8)]
NUMERIC = [f"{s}_F{j}" for s in STATIONS for j in (1, 2)]
DATES = [f"{s}_D1" for s in STATIONS]
CATEGORIES = [f"{s}_C1" for s in STATIONS]
_DAY0 = "1995-01-01"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row an order: Id, Response, and for station k what the order's line k measured. Lines, which are narrow, meet by
    order before they become an order's columns."""
    orders, lines = load(spark, sf_dir, "orders"), load(spark, sf_dir, "lineitem")
    lines = lines.repartition("l_orderkey")
    day = F.datediff(F.col("l_shipdate"), F.lit(_DAY0).cast("date")).cast("double")
    cols = []
    for k, s in enumerate(STATIONS, 1):
        mine = lambda c, k=k: F.min(F.when(F.col("l_linenumber") == k, c))
        cols += [mine(F.col("l_quantity")).alias(f"{s}_F1"), mine(F.col("l_extendedprice")).alias(f"{s}_F2"), mine(day).alias(f"{s}_D1"), mine(F.col("l_returnflag")).alias(f"{s}_C1")]
    per = lines.groupBy("l_orderkey").agg(*cols)
    base = orders.select(F.col("o_orderkey").alias("Id"), ((F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") == "1-URGENT")).cast("int").alias("Response"))
    return base.join(per, base["Id"] == per["l_orderkey"], "left").drop("l_orderkey")


_PART_COLS = ", ".join(
    f'min(CASE WHEN l_linenumber = {k} THEN l_quantity END) AS "{s}_F1", min(CASE WHEN l_linenumber = {k} THEN l_extendedprice END) AS "{s}_F2", '
    f"min(CASE WHEN l_linenumber = {k} THEN CAST(date_diff('day', DATE '{_DAY0}', CAST(l_shipdate AS DATE)) AS DOUBLE) END) AS \"{s}_D1\", min(CASE WHEN l_linenumber = {k} THEN l_returnflag END) AS \"{s}_C1\""
    for k, s in enumerate(STATIONS, 1)
)
PARTS = f"""parts AS (SELECT o_orderkey AS "Id", CAST(o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' AS INTEGER) AS "Response", {_PART_COLS}
  FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_orderstatus, o_orderpriority)"""


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Id, t (tenths of an hour since 2024-01-01, floored), Response, value of events."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    t = F.floor((micros - 1704067200000000) / F.lit(360000000)).cast("double")
    return load(spark, sf_dir, "events").select(F.col("event_id").alias("Id"), t.alias("t"), (F.col("event_type") == "error").cast("int").alias("Response"), "value")


TICKS = """ticks AS (SELECT event_id AS "Id", CAST(floor((epoch_us(ts) - 1704067200000000) / 360000000.0) AS DOUBLE) AS t, CAST(event_type = 'error' AS INTEGER) AS "Response", value FROM events)"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Id, Response, pred of orders; scores repeat."""
    y = ((F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") == "1-URGENT")).cast("int")
    h = ((F.col("o_orderkey") * 7919) % 10007).cast("double") / F.lit(10007.0)
    return load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("Id"), y.alias("Response"), (h * h * F.lit(0.75) + F.lit(0.2) * y.cast("double")).alias("pred"))


SCORES = """scores AS (SELECT o_orderkey AS "Id", CAST(o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' AS INTEGER) AS "Response",
  (CAST((o_orderkey * 7919) % 10007 AS DOUBLE) / 10007.0::DOUBLE) * (CAST((o_orderkey * 7919) % 10007 AS DOUBLE) / 10007.0::DOUBLE) * 0.75::DOUBLE
  + 0.2::DOUBLE * CAST(CAST(o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' AS INTEGER) AS DOUBLE) AS pred FROM orders)"""


def scores_alt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second score, absent for every tenth order."""
    h = ((F.col("o_orderkey") * 104729) % 9973).cast("double") / F.lit(9973.0)
    f = (F.col("o_orderstatus") == "F").cast("int").cast("double")
    return load(spark, sf_dir, "orders").where("o_orderkey % 10 <> 0").select(F.col("o_orderkey").alias("Id"), (h * F.lit(0.8) + F.lit(0.15) * f).alias("pred"))


SCORES_ALT = """scores_alt AS (SELECT o_orderkey AS "Id", CAST((o_orderkey * 104729) % 9973 AS DOUBLE) / 9973.0::DOUBLE * 0.8::DOUBLE
  + 0.15::DOUBLE * CAST(CAST(o_orderstatus = 'F' AS INTEGER) AS DOUBLE) AS pred FROM orders WHERE o_orderkey % 10 <> 0)"""


def oof3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Id, Response and three base scores: p1, p2 (absent: 0) and their mean p3."""
    s, a = scores(spark, sf_dir), scores_alt(spark, sf_dir).withColumnRenamed("pred", "alt")
    j = s.join(a, "Id", "left").select("Id", "Response", F.col("pred").alias("p1"), F.coalesce("alt", F.lit(0.0)).alias("p2"))
    return j.withColumn("p3", (F.col("p1") + F.col("p2")) / 2)


OOF3 = f"""{SCORES}, {SCORES_ALT}, oof3 AS (SELECT s."Id", s."Response", s.pred AS p1, coalesce(a.pred, 0.0::DOUBLE) AS p2,
  (s.pred + coalesce(a.pred, 0.0::DOUBLE)) / 2 AS p3 FROM scores s LEFT JOIN scores_alt a ON s."Id" = a."Id")"""


def runs_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Id, two key columns with nulls, score and duration of events in Id order."""
    kind = F.when(F.col("event_type") != "view", F.col("event_type"))
    user = F.when(F.col("user_id") % 3 != 0, F.col("user_id") % 2)
    return load(spark, sf_dir, "events").select(F.col("event_id").alias("Id"), kind.alias("k1"), user.alias("k2"), F.col("event_id").cast("double").alias("start_time"), (F.col("event_id") * 37 % 101 / F.lit(101.0)).alias("score"), F.col("value").alias("duration"))


RUNS_SOURCE = """src AS (SELECT event_id AS "Id", nullif(event_type, 'view') AS k1, CASE WHEN user_id % 3 <> 0 THEN user_id % 2 END AS k2, CAST(event_id AS DOUBLE) AS start_time,
  CAST(event_id * 37 % 101 AS DOUBLE) / 101.0::DOUBLE AS score, value AS duration FROM events)"""
RUNS = f"""{RUNS_SOURCE}, flagged AS (SELECT *, CASE WHEN row_number() OVER (ORDER BY start_time, "Id") > 1 AND k1 IS NOT DISTINCT FROM lag(k1) OVER (ORDER BY start_time, "Id")
  AND k2 IS NOT DISTINCT FROM lag(k2) OVER (ORDER BY start_time, "Id") THEN 1 ELSE 0 END AS is_duplicate FROM src),
numbered AS (SELECT *, CAST(sum(1 - is_duplicate) OVER (ORDER BY start_time, "Id" ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run_id FROM flagged),
runs AS (SELECT *, count(*) OVER (PARTITION BY run_id) AS run_size, row_number() OVER (PARTITION BY run_id ORDER BY start_time, "Id") AS run_rank,
  row_number() OVER (PARTITION BY run_id ORDER BY start_time DESC, "Id" DESC) AS run_rank_desc FROM numbered)"""
