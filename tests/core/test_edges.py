"""Semantics on tiny frames: ties, nulls, bounds, golden arithmetic."""

import random

import pytest
from pyspark.sql import functions as F

from millwatch.operators import decide, metrics, ordering, paths, rowwise, runs
from millwatch.sources import io
from millwatch.streaming import replay


def test_global_index_with_ties_and_nulls(spark):
    r = random.Random(1)
    data = [(i, r.choice([None, 1.0, 1.0, 1.0, r.random()])) for i in range(2000)]
    df = spark.createDataFrame(data, "Id long, k double").repartition(7)
    got = {x["Id"]: x["idx"] for x in ordering.global_index(df, "k", "Id").collect()}
    want = {d[0]: n for n, d in enumerate(sorted(data, key=lambda d: (d[1] is None, d[1] or 0, d[0])))}
    assert got == want
    down = {x["Id"]: x["idx"] for x in ordering.global_index(df, "k", "Id", descending=True).collect()}
    assert down == {d[0]: n for n, d in enumerate(sorted(data, key=lambda d: (d[1] is None, -(d[1] or 0), d[0])))}


def test_trailing_count_is_a_two_pointer_sweep(spark):
    r = random.Random(2)
    data = [(i, float(r.randint(0, 60))) for i in range(400)]
    got = {x["Id"]: x["n"] for x in ordering.trailing_count(spark.createDataFrame(data, "Id long, t double"), "t", "Id", 5.0, "n").collect()}
    line, left = sorted(data, key=lambda d: (d[1], d[0])), 0
    for right, (i, t) in enumerate(line):
        while t - line[left][1] > 5.0:
            left += 1
        assert got[i] == right - left + 1


def test_runs_treat_nulls_as_equal(spark):
    keys = [None, None, "a", "a", None, "a", "a", "a"]
    df = spark.createDataFrame([(i, float(i), k) for i, k in enumerate(keys)], "Id long, start_time double, k string")
    got = [tuple(x) for x in runs.adjacent_runs(df, ["k"]).orderBy("Id").select("is_duplicate", "run_id", "run_size", "run_rank").collect()]
    assert got == [(0, 1, 2, 1), (1, 1, 2, 2), (0, 2, 2, 1), (1, 2, 2, 2), (0, 3, 1, 1), (0, 4, 3, 1), (1, 4, 3, 2), (1, 4, 3, 3)]


def test_golden_counts(spark):
    c = spark.createDataFrame([(3099, 19019, 3780, 1157849)], "tp long, fp long, fn long, tn long")
    one = metrics.rates(c).withColumns({"mcc": metrics.mcc(), "cost": metrics.cost()}).first()
    assert one["cost"] == 473095.0
    assert round(one["mcc"], 5) == 0.24381
    assert round(one["cost"] / 1183747 * 100000, 3) == 39965.888


def test_budget_formulas_differ(spark):
    assert spark.range(1).select(decide.budget_rows(F.lit(100), 7)).first()[0] == 7
    assert metrics.percent_rows(100, 7) == 8


def test_float_threshold(spark):
    df = spark.createDataFrame([(0.7,)], "p float")
    assert df.select(decide.over_threshold("p", 0.7)).first()[0] == 1
    assert df.select(decide.over_threshold("p", 0.7, single=False)).first()[0] == 0


def test_signatures(spark):
    df = spark.createDataFrame([("a|b|c",), ("a",), ("__none__",), (None,)], "s string")
    t = paths.parse(F.col("s"))
    got = [tuple(x) for x in df.select(t, paths.transitions(t), paths.pairs(t)).collect()]
    assert got == [(["a", "b", "c"], ["a>b", "b>c"], ["a&b", "a&c", "b&c"]), (["a"], [], []), ([], [], []), ([], [], [])]


def test_fill_start(spark):
    none = spark.createDataFrame([(7, None), (3, None)], "Id long, start_time double")
    assert {x["Id"]: x["fill_time"] for x in rowwise.fill_start(none).collect()} == {3: 0.0, 7: 1.0}
    some = spark.createDataFrame([(1, None), (2, 5.0)], "Id long, start_time double")
    assert {x["Id"]: x["fill_time"] for x in rowwise.fill_start(some).collect()} == {1: 4.0, 2: 5.0}


def test_bad_arguments(spark):
    df = spark.createDataFrame([(1, 1, 0.5)], "Id long, Response int, pred double")
    for f in (lambda: ordering.chunk_ids(df, "pred", "Id", 0), lambda: decide.batches(df, -1), lambda: decide.hybrid(df, percent=101), lambda: metrics.best_source({})):
        with pytest.raises(ValueError):
            f()
    with pytest.raises(FileNotFoundError, match="absent.csv"):
        io.read_tables(spark, "/tmp/no-such-folder", {"absent.csv": "a int"})


def test_stream_equals_batch(spark, tmp_path):
    df = spark.createDataFrame([(i, int(i % 7 == 0), (i * 37 % 101) / 101) for i in range(300)], "Id long, Response int, pred double")
    replay.write_batches(df, f"{tmp_path}/in", 100)
    for _ in range(2):  # the second run finds nothing new
        replay.run_stream(spark, f"{tmp_path}/in", f"{tmp_path}/log", f"{tmp_path}/checkpoint")
    log = spark.read.parquet(f"{tmp_path}/log")
    want = replay.batch_metrics(decide.batches(df, 100))
    cols = ["tp", "fp", "fn", "tn", "rows", "auto_reject_count", "manual_inspect_count"]
    assert sorted(map(tuple, log.select(*cols).collect())) == sorted(map(tuple, want.select(*cols).collect()))
