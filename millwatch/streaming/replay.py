"""Replay of scored rows: one window, all batches, or as a stream of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millwatch.operators import decide, metrics
from millwatch.operators.ordering import global_index
from millwatch.sources import io

SCHEMA = "Id long, Response int, pred double, batch_id long"


def batch_metrics(df: DataFrame, threshold: float = 0.6, percent: float = 5.0, batch: str = "batch", position: str | None = "position") -> DataFrame:
    """A row a batch: hybrid decisions' confusion, counts, and the score's mean and deviation (population)."""
    d = decide.hybrid(df, threshold, percent, batch=batch)
    more = [F.min(position).alias("batch_start"), (F.max(position) + 1).alias("batch_end")] if position else []
    out = d.groupBy(batch).agg(*metrics.counts(), F.count("*").alias("rows"), F.sum("auto_reject").alias("auto_reject_count"), F.sum("manual_inspect").alias("manual_inspect_count"), F.avg("pred").alias("pred_mean"), F.stddev_pop("pred").alias("pred_std"), *more)
    return metrics.rates(out)


def replay_summary(batches: DataFrame) -> DataFrame:
    """Means over batches, and sample deviations as drift signals."""
    cols = ["precision", "recall", "flagged_pct", "pred_mean", "pred_std"]
    return batches.agg(F.count("*").alias("batches"), *[F.avg(c).alias(f"{c}_mean") for c in cols], *[F.stddev_samp(c).alias(f"{c}_std") for c in cols])


def replay_window(df: DataFrame, pointer: int, size: int, threshold: float = 0.6, percent: float = 5.0) -> DataFrame:
    """One row: metrics of the rows from `pointer` in id order, the next pointer, and whether it went back to 0. A
    pointer outside the table counts as 0."""
    i = global_index(df, "Id", "Id", "_i")
    n = df.agg(F.count("*").alias("_all"))
    p = F.when((F.lit(pointer) >= 0) & (F.lit(pointer) < F.col("_all")), F.lit(pointer)).otherwise(0)
    rows = i.crossJoin(F.broadcast(n)).withColumn("start", p.cast("long")).where((F.col("_i") >= F.col("start")) & (F.col("_i") < F.col("start") + size))
    d = decide.hybrid(rows.withColumn("batch", F.lit(0)), threshold, percent, batch="batch")
    out = d.agg(F.min("start").alias("start"), (F.max("_i") + 1).alias("end"), F.max("_all").alias("_all"), F.count("*").alias("rows"), *metrics.counts(), F.sum("auto_reject").alias("auto_reject_count"), F.sum("manual_inspect").alias("manual_inspect_count"))
    out = metrics.rates(out).withColumn("reset_triggered", F.col("end") >= F.col("_all"))
    return out.withColumn("next_pointer", F.when(F.col("reset_triggered"), F.lit(0)).otherwise(F.col("end")).cast("long")).drop("_all")


def write_batches(df: DataFrame, folder: str, size: int) -> None:
    """Files for the stream, whole batches each, partitioned by batch_id."""
    b = decide.batches(df, size, out="batch_id").select("Id", "Response", "pred", F.col("batch_id").cast("long").alias("batch_id"))
    b.repartition("batch_id").sortWithinPartitions("batch_id", "Id").write.mode("overwrite").parquet(folder)


def run_stream(spark: SparkSession, folder: str, log: str, checkpoint: str, threshold: float = 0.6, percent: float = 5.0) -> None:
    """Replays the files that are there, one a trigger; each batch's metrics replace its own partition of the log, so a
    restart neither loses nor repeats a batch."""

    def act(rows: DataFrame, _: int) -> None:
        io.append_log(batch_metrics(rows, threshold, percent, batch="batch_id", position=None), log)

    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    q = stream.writeStream.foreachBatch(act).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def action_stream(spark: SparkSession, folder: str, out: str, checkpoint: str, threshold: float = 0.5) -> None:
    """Scores to actions, row by row, appended."""
    from millwatch.operators.rowwise import action

    stream = spark.readStream.schema(SCHEMA).parquet(folder)
    q = stream.select("Id", "pred", action(F.col("pred"), threshold).alias("action")).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
