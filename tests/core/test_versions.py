"""States, models and summaries that are replaced as a whole or not at all."""

import pytest
from pyspark.sql import functions as F

from millwatch.operators import model, state
from millwatch.sources import io


def a_state(spark, x):
    one = spark.range(1).select(F.lit(x).alias("v"))
    return state.State(*[one] * len(state.State.NAMES))


def test_a_writer_stopped_midway(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "state")
    with pytest.raises(FileNotFoundError, match="no whole version"):
        state.State.load(spark, path)
    a_state(spark, 1).save(path)
    broken = a_state(spark, 2)
    broken.medians = spark.range(1).select(F.raise_error(F.lit("stop")).alias("v"))
    with pytest.raises(Exception, match="stop"):
        broken.save(path)
    old = state.State.load(spark, path)
    assert all(getattr(old, n).first()["v"] == 1 for n in state.State.NAMES)
    a_state(spark, 3).save(path)
    # a reader of the earlier version still can
    assert state.State.load(spark, path).mean.first()["v"] == 3 and old.mean.first()["v"] == 1


def test_summary(spark, tmp_path):
    path = str(tmp_path / "summary")
    oof = spark.range(200).select(F.col("id").alias("Id"), (F.col("id") % 3 == 0).cast("int").alias("Response"), F.when(F.col("id") % 3 == 0, 0.8).otherwise(0.3).alias("oof_pred"), (F.col("id") % 5).cast("int").alias("cv_fold"))
    model.record(oof.withColumn("oof_pred", F.rand(1)), "a", path)
    model.record(oof, "b", path)
    got = {r["model"]: r for r in model.record(oof, "a", path).collect()}
    assert set(got) == {"a", "b"} and got["a"]["threshold"] == 0.31 and got["a"]["mcc"] == 1.0
    assert got["a"]["rows"] == 200 and got["a"]["folds"] == 5 and [f["rows"] for f in got["a"]["by_fold"]] == [40] * 5
    with pytest.raises(Exception, match="stop"):
        io.update_summary(spark.range(1).select(F.raise_error(F.lit("stop")).cast("string").alias("model")), path, "model")
    assert spark.read.parquet(io.last_version(spark, path)).count() == 2
