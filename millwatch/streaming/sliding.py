"""Replay by a saved policy and position: a report of all batches, one window a step, and drift signals kept as state.

A step reads its window only, from scores that are stored in id order. It writes its row of the log, then its state as a
new version, so a step that stops midway is done again from the same position and replaces its own row. Steps that follow
each other may be made together: their windows are one job, their state is the last one's. Drift signals (means and sample
deviations of batch metrics so far) are a stateful stream over the log: a few numbers a source, however many batches there
were.

Defined results: a missing policy file, or a missing value in it, gives the default; a file that is no JSON is an error. A
position outside the table counts as 0; a table without rows has no step and is an error. Null scores are never over a
threshold and come last in a batch's budget. In the signals a batch counts once, also when the log's row of it was
written again; a null metric leaves its own mean and deviation as they are; the deviation of less than two values is null.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millwatch.operators import decide, metrics
from millwatch.operators.ordering import global_index
from millwatch.sources import io
from millwatch.streaming import replay

SIGNALS = ("precision", "recall", "flagged_pct", "pred_mean", "pred_std")
STATE = "step long, pointer long, last_start long, last_end long, batch_size long, schedule_seconds long, dataset_rows long, reset_on_end boolean"


@dataclass(frozen=True)
class Policy:
    threshold_high: float = 0.60
    inspection_budget_pct: float = 5.0


def load_policy(spark: SparkSession, path: str) -> Policy:
    """The policy that a summary recommends (final_recommendation.threshold_high and .inspection_budget_pct)."""
    fields = "final_recommendation struct<threshold_high: double, inspection_budget_pct: double>"
    try:
        found = spark.read.schema(fields).json(path, mode="FAILFAST", multiLine=True).select("final_recommendation.*").first()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        found = None
    return Policy(**{k: v for k, v in (found.asDict() if found else {}).items() if v is not None})


def save_policy(spark: SparkSession, policy: Policy, path: str) -> None:
    one = F.struct(F.lit(policy.threshold_high).alias("threshold_high"), F.lit(policy.inspection_budget_pct).alias("inspection_budget_pct"))
    io.write_summary(spark.range(1).select(one.alias("final_recommendation")).coalesce(1), path)


def replay_report(sources: dict[str, DataFrame], policy: Policy, size: int, schedule_seconds: int = 60) -> DataFrame:
    """One row: the best source in batches under the policy, with means and drift signals of the batches' metrics."""
    best = io.stored(metrics.best_source(sources), "best")
    batches = replay.batch_metrics(decide.batches(best.drop("source", "mcc"), size), policy.threshold_high, policy.inspection_budget_pct)
    name = best.agg(F.max("source").alias("source"), F.max("mcc").alias("source_mcc"))
    given = {"threshold_high": float(policy.threshold_high), "inspection_budget_pct": float(policy.inspection_budget_pct), "batch_size": int(size), "schedule_seconds": int(schedule_seconds)}
    return name.select("*", *[F.lit(v).alias(k) for k, v in given.items()]).crossJoin(F.broadcast(replay.replay_summary(batches)))


def place_scores(df: DataFrame, folder: str) -> DataFrame:
    """Id, Response, pred and position (in id order), stored by position, so that a window's files alone are read."""
    placed = global_index(df.select("Id", "Response", "pred"), "Id", "Id", "position")
    placed.repartitionByRange("position").sortWithinPartitions("position").write.mode("overwrite").parquet(folder)
    return df.sparkSession.read.parquet(folder)


def position(spark: SparkSession, folder: str) -> dict:
    """The state after the last whole step; before the first, step and pointer 0."""
    try:
        path = io.last_version(spark, f"{folder}/state")
    except FileNotFoundError:
        return {"step": 0, "pointer": 0}
    return spark.read.schema(STATE).json(path).first().asDict()


def slide(placed: DataFrame, folder: str, size: int, policy: Policy = Policy(), schedule_seconds: int = 60, windows: int = 1) -> dict:
    """Replays the windows from the saved position on, so many of them and up to the table's end at most, and gives the
    new state. Log (a row a step, which is a window) and state lie in folder; if it stops midway, all its steps are done
    again and replace their own rows."""
    if size <= 0 or windows <= 0:
        raise ValueError("batch size and number of windows must be positive")
    spark = placed.sparkSession
    at = position(spark, folder)
    n = placed.agg(F.max("position") + 1).first()[0]
    if not n:
        raise ValueError("no scored rows to replay")
    start = at["pointer"] if 0 <= at["pointer"] < n else 0
    end = min(n, start + size * windows)
    steps = -(-(end - start) // size)
    step = F.expr(f"{at['step']}L + (position - {start}L) div {size}L")
    rows = placed.where((F.col("position") >= start) & (F.col("position") < end)).withColumn("step", step)
    row = replay.batch_metrics(rows, policy.threshold_high, policy.inspection_budget_pct, batch="step")
    given = {"schedule_seconds": int(schedule_seconds), "batch_size": int(size), "threshold_high": float(policy.threshold_high), "inspection_budget_pct": float(policy.inspection_budget_pct)}
    io.append_log(row.withColumns({"reset_triggered": F.col("batch_end") >= n} | {k: F.lit(v) for k, v in given.items()}), f"{folder}/log", "step")
    new = {"step": at["step"] + steps, "pointer": 0 if end >= n else end, "last_start": start + size * (steps - 1), "last_end": end, "batch_size": int(size), "schedule_seconds": int(schedule_seconds), "dataset_rows": n, "reset_on_end": True}
    with io.new_version(spark, f"{folder}/state") as version:
        spark.createDataFrame([tuple(new.values())], STATE).coalesce(1).write.json(version)
    return new


def _running(batch: str):
    """Means and squared deviations so far, a batch at a time (Welford); batches up to the last one seen are known."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last, batches, *held = state.get if state.exists else (None, 0, *[0, 0.0, 0.0] * len(SIGNALS))
        out = []
        for row in pd.concat(list(frames)).sort_values(batch).drop_duplicates(batch).itertuples(index=False):
            number = getattr(row, batch)
            if last is not None and number <= last:
                continue
            last, batches = int(number), batches + 1
            shown = []
            for k, name in enumerate(SIGNALS):
                n, mean, squares = held[3 * k : 3 * k + 3]
                value = getattr(row, name)
                if value is not None and not math.isnan(value):
                    n, off = n + 1, value - mean
                    mean += off / n
                    squares += off * (value - mean)
                    held[3 * k : 3 * k + 3] = n, mean, squares
                shown += [mean if n else None, math.sqrt(squares / (n - 1)) if n > 1 else None]
            out.append((*key, last, batches, *shown))
        if last is not None:
            state.update((last, batches, *held))
        columns = ["source", batch, "batches", *[f"{c}_{f}" for c in SIGNALS for f in ("mean", "std")]]
        yield pd.DataFrame(out, columns=columns).astype({f"{c}_{f}": "float64" for c in SIGNALS for f in ("mean", "std")})

    return step


def drift_signals(log: DataFrame, batch: str = "batch_id", source: str | None = None) -> DataFrame:
    """A stream of batch metrics to a row for each new batch of a source: batches so far, their metrics' means and sample
    deviations. A source's batches come in ascending order over triggers; what one trigger brings is sorted."""
    key = F.lit("all") if source is None else F.col(source).cast("string")
    rows = log.select(F.coalesce(key, F.lit("")).alias("source"), F.col(batch).cast("long").alias(batch), *[F.col(c).cast("double").alias(c) for c in SIGNALS]).where(F.col(batch).isNotNull())
    shown = ", ".join(f"{c}_mean double, {c}_std double" for c in SIGNALS)
    held = ", ".join(f"{c}_n long, {c}_mean double, {c}_squares double" for c in SIGNALS)
    return rows.groupBy("source").applyInPandasWithState(_running(batch), f"source string, {batch} long, batches long, {shown}", f"last long, batches long, {held}", "append", "NoTimeout")


def run_signals(spark: SparkSession, log: str, out: str, checkpoint: str, batch: str = "batch_id", source: str | None = None) -> None:
    """Signals of the log's batches that are new since the last run, appended to out; the checkpoint holds the state. A
    stream takes files by time of writing, and a log's files aren't written in the order of batches: so one trigger brings
    all new ones (a few numbers a batch), and sorts them."""
    schema = spark.read.parquet(log).schema
    stream = spark.readStream.schema(schema).parquet(log)
    q = drift_signals(stream, batch, source).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
