"""Policy files, replay by a saved position, and drift signals over restarts."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from millwatch.operators import decide
from millwatch.sources import io
from millwatch.streaming import replay, sliding


def scores(spark, n):
    return spark.range(n).select(F.col("id").alias("Id"), (F.col("id") % 7 == 0).cast("int").alias("Response"), F.when(F.col("id") % 11 != 0, (F.col("id") * 37 % 101) / 101).alias("pred"))


def test_policy(spark, tmp_path):
    assert sliding.load_policy(spark, f"{tmp_path}/none.json") == sliding.Policy(0.6, 5.0)
    (tmp_path / "part.json").write_text('{\n "final_recommendation": {"threshold_high": 0.55, "note": "x"},\n "other": [1]\n}')
    assert sliding.load_policy(spark, f"{tmp_path}/part.json") == sliding.Policy(0.55, 5.0)
    (tmp_path / "bare.json").write_text('{"other": 1}')
    assert sliding.load_policy(spark, f"{tmp_path}/bare.json") == sliding.Policy()
    (tmp_path / "broken.json").write_text("{no json")
    with pytest.raises(Exception, match="(?i)malformed"):
        sliding.load_policy(spark, f"{tmp_path}/broken.json")
    sliding.save_policy(spark, sliding.Policy(0.7, 2.5), f"{tmp_path}/saved")
    assert sliding.load_policy(spark, f"{tmp_path}/saved") == sliding.Policy(0.7, 2.5)


def test_slide(spark, tmp_path, monkeypatch):
    df, base = scores(spark, 250), str(tmp_path / "replay")
    placed = sliding.place_scores(df, f"{base}/scores")
    first = sliding.slide(placed, base, 100)
    assert (first["step"], first["pointer"], first["last_start"], first["last_end"]) == (1, 100, 0, 100)
    # a step whose state is never written is done again, and its row of the log is there once
    with monkeypatch.context() as m, pytest.raises(RuntimeError, match="stop"):
        m.setattr(io, "new_version", lambda *_: (_ for _ in ()).throw(RuntimeError("stop")))
        sliding.slide(placed, base, 100)
    assert sliding.position(spark, base)["pointer"] == 100
    got = [sliding.slide(placed, base, 100) for _ in range(3)]
    assert [(g["last_start"], g["last_end"], g["pointer"]) for g in got] == [(100, 200, 200), (200, 250, 0), (0, 100, 100)]
    log = spark.read.parquet(f"{base}/log").orderBy("step").collect()
    assert [r["step"] for r in log] == [0, 1, 2, 3] and [r["reset_triggered"] for r in log] == [False, False, True, False]
    want = {r["batch"]: r for r in replay.batch_metrics(decide.batches(df, 100)).collect()}
    for r, k in zip(log, (0, 1, 2, 0), strict=True):
        assert all(r[c] == want[k][c] for c in ("rows", "tp", "fp", "fn", "tn", "batch_start", "batch_end", "pred_mean"))
    with pytest.raises(ValueError, match="no scored rows"):
        sliding.slide(placed.limit(0), str(tmp_path / "other"), 100)


def test_signals_over_restarts(spark, tmp_path):
    m = replay.batch_metrics(decide.batches(scores(spark, 600), 100)).withColumnRenamed("batch", "batch_id").withColumn("source", F.when(F.col("batch_id") < 5, "a"))
    m = m.withColumn("recall", F.when(F.col("batch_id") != 2, F.col("recall"))).drop("batch_start", "batch_end")
    log, out, check = (f"{tmp_path}/{x}" for x in ("log", "out", "check"))
    for some in ("batch_id < 2", "batch_id in (1, 2, 3)", "batch_id > 3"):  # batch 1 is written again
        io.append_log(m.where(some), log)
        sliding.run_signals(spark, log, out, check, source="source")
    got = spark.read.parquet(out).toPandas().sort_values(["source", "batch_id"])
    assert list(zip(got.source, got.batch_id, got.batches, strict=True)) == [("", 5, 1), *[("a", k, k + 1) for k in range(5)]]
    rows = m.toPandas().sort_values("batch_id")
    for source, part in rows.groupby(rows.source.fillna("")):
        mine = got[got.source == source]
        for c in sliding.SIGNALS:
            grown = part[c].astype(float).expanding()
            pd.testing.assert_series_equal(mine[f"{c}_mean"].reset_index(drop=True), grown.mean().reset_index(drop=True), check_names=False)
            pd.testing.assert_series_equal(mine[f"{c}_std"].reset_index(drop=True), grown.std().reset_index(drop=True), check_names=False)
    sliding.run_signals(spark, log, f"{tmp_path}/once", f"{tmp_path}/new", source="source")
    once = spark.read.parquet(f"{tmp_path}/once").toPandas().sort_values(["source", "batch_id"])
    pd.testing.assert_frame_equal(got.reset_index(drop=True), once.reset_index(drop=True))


def test_windows_together(spark, tmp_path):
    """Steps made together leave the log and the state that single ones do; the last window of a round may be short."""
    placed = sliding.place_scores(scores(spark, 250), f"{tmp_path}/scores")
    one, some = f"{tmp_path}/one", f"{tmp_path}/some"
    for _ in range(6):
        last = sliding.slide(placed, one, 30)
    assert sliding.slide(placed, some, 30, windows=4)["pointer"] == 120
    assert sliding.slide(placed, some, 30, windows=2) == last and sliding.position(spark, some) == last
    for _ in range(3):
        last = sliding.slide(placed, one, 30)
    assert sliding.slide(placed, some, 30, windows=100) == last and last["pointer"] == 0 and last["last_start"] == 240
    logs = [[r.asDict() for r in spark.read.parquet(f"{f}/log").orderBy("step").collect()] for f in (one, some)]
    assert logs[0] == logs[1] and [r["reset_triggered"] for r in logs[1]] == [False] * 8 + [True]


def test_signals_of_a_log_in_any_order(spark, tmp_path):
    """More than 1,000 batches whose files were written from the last to the first: none is lost."""
    n, log = 1010, f"{tmp_path}/log"
    m = spark.range(n).select(F.col("id").alias("batch_id"), *[(F.col("id") * k % 7).cast("double").alias(c) for k, c in enumerate(sliding.SIGNALS, 1)])
    io.append_log(m.where("batch_id >= 5").coalesce(1), log)
    io.append_log(m.where("batch_id < 5").coalesce(1), log)
    sliding.run_signals(spark, log, f"{tmp_path}/out", f"{tmp_path}/check")
    got = spark.read.parquet(f"{tmp_path}/out").orderBy("batch_id").toPandas()
    assert list(got.batch_id) == list(range(n)) and list(got.batches) == list(range(1, n + 1))
    pd.testing.assert_series_equal(got.recall_mean, m.toPandas().recall.expanding().mean(), check_names=False)
