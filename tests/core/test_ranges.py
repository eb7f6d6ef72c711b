"""Ordered operators over many small ranges give what one range gives, also with most keys null and one very long run."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from millwatch.operators import drift, encode, folds, history, joins, ordering, paths, runs

MOST = 40


def rows(df):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*sorted(df.columns)).collect()), key=str)


@pytest.fixture(scope="module")
def parts(spark):
    r = random.Random(5)
    data = []
    for i in range(900):
        t = None if r.random() < 0.9 else float(r.randint(0, 30))
        m = None if r.random() < 0.9 else r.choice([0.0, 0.0, 0.0, 1.5])
        data.append((i, t, m, None if m is None else r.choice([None, 2.0]), "same" if 100 < i < 800 else r.choice(["a", "b"]), int(r.random() < 0.2), r.random(), i % 11))
    return spark.createDataFrame(data, "Id long, start_time double, m1 double, m2 double, k string, Response int, score double, chunk int").repartition(5).cache()


def both(monkeypatch, make):
    monkeypatch.setattr(ordering, "ROWS", 1 << 19)
    one = rows(make())
    monkeypatch.setattr(ordering, "ROWS", MOST)
    assert rows(make()) == one
    # groups beyond the bound for broadcasting, those of more than 50 rows heavy
    monkeypatch.setattr(ordering, "MOST_GROUPS", 1)
    monkeypatch.setattr(ordering, "HEAVY", 50)
    monkeypatch.setattr(encode, "MAP_VALUES", 0)
    assert rows(make()) == one
    monkeypatch.setattr(ordering, "MOST_GROUPS", 20)
    assert rows(make()) == one
    return one


RATES = [("k", "same", 0.5), ("k", "a", 0.25), ("cat", "7", 0.75), ("cat", "8", 0.125)]

CASES = {
    "same_window": lambda d: ordering.around_count(d, "start_time", 3.0, "n"),
    "wide_window": lambda d: ordering.trailing_counts(d, "start_time", "Id", {"all": 31.0, "odd": 0.3, "huge": 1e12}),
    "frequency": lambda d: paths.frequency(d, "k", "n"),
    "oof": lambda d: encode.oof_rate(d, "start_time", fold="chunk"),
    "encoding": lambda d: encode.apply_encoding(d.withColumn("cat", F.when(F.col("Id") % 9 == 0, F.col("Id") % 40)), d.sparkSession.createDataFrame(RATES, "col string, value string, rate double"), ["k", "cat", "none"], d.sparkSession.createDataFrame([(0.1,)], "g double")),
    "lookup": lambda d: joins.lookup(d, d.sparkSession.createDataFrame([("same", 1.0), (None, 2.0)], "k string, v double"), "k", "v", d.sparkSession.createDataFrame([(0.1,)], "g double"), "out"),
    "index": lambda d: ordering.global_index(d, "start_time", "Id"),
    "index_down": lambda d: ordering.global_index(d, "m1", "Id", descending=True),
    "index_within": lambda d: ordering.global_index(d, "start_time", "Id", within=["k"]),
    "trailing": lambda d: ordering.trailing_counts(d.where("start_time is not null or Id < 0").unionByName(d.where("start_time is null").withColumn("start_time", F.lit(-1.0))), "start_time", "Id", {"w1": 1.0, "w5": 5.0}, place="p"),
    "as_of": lambda d: ordering.as_of(d, d.where("m1 is not null").select(F.col("start_time").alias("rt"), F.col("Id").alias("rid"), F.col("m1").alias("v")), "start_time", "rt", "rid", ["v"]),
    "as_of_strict": lambda d: ordering.as_of(d, d.select("k", F.col("start_time").alias("rt"), F.col("Id").alias("rid"), F.col("score").alias("v")), "start_time", "rt", "rid", ["v"], strict=True, within=["k"]),
    "runs": lambda d: runs.adjacent_runs(d, ["k"]),
    "runs_by_id": lambda d: runs.adjacent_runs(d.withColumn("start_time", F.col("Id").cast("double")), ["k"]),
    "stations": lambda d: runs.station_duplicates(d, {"s": ["m1", "m2"]}),
    "rounded": lambda d: runs.rounded_duplicates(d, {"s": ["m1", "m2"]}, least=0.0),
    "since": lambda d: history.since_failures(d, d.where("Response = 1").select(F.col("start_time").alias("ft"), F.col("Id").alias("fid")), "start_time", "ft", "fid", (1, 3)),
    "rate": lambda d: history.trailing_rate(d, "start_time", "Id", "Response", 50, "r", ["k"]),
    "oof_rate_back": lambda d: history.oof_trailing_rate(d.withColumn("cv_fold", F.when(F.col("Id") % 50 != 0, F.col("Id") % 4)), rows=90),
    "folds": lambda d: folds.group_folds(d, "Id", folds=5),
    "percentiles": lambda d: encode.percentiles(d, ["score", "start_time", "m1"], [0.1, 0.5, 0.9]),
    "wasserstein": lambda d: drift.wasserstein(d.where("Id % 3 = 0"), d.where("Id % 3 > 0"), ["score", "start_time"]),
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_ranges(parts, monkeypatch, name):
    assert both(monkeypatch, lambda: CASES[name](parts))


def test_windows_of_any_width(spark):
    """Inclusive edges, also where widths aren't powers of two, by brute force."""
    r = random.Random(8)
    data = [(i, round(r.random() * 20, 1)) for i in range(400)]
    d = spark.createDataFrame(data, "Id long, t double")
    widths = {"a": 0.1, "b": 0.3, "c": 7.7, "d": 25.0}
    got = {x["Id"]: x for x in ordering.around_count(ordering.trailing_counts(d, "t", "Id", widths), "t", 0.6, "near").collect()}
    for i, t in data:
        for name, w in widths.items():
            assert got[i][name] == sum(t - w <= u and (u, j) <= (t, i) for j, u in data)
        assert got[i]["near"] == sum(t - 0.3 <= u <= t + 0.3 for _, u in data) - 1


def test_trailing_rate_of_other_folds(spark, monkeypatch):
    """By definition, over ranges shorter and longer than the window, with ties, null keys and one fold of most rows."""
    r = random.Random(4)
    data = [(i, r.choice([None, float(r.randint(0, 40))]), 0 if r.random() < 0.8 else r.randint(1, 3), int(r.random() < 0.3)) for i in r.sample(range(5000), 500)]
    d = spark.createDataFrame(data, "Id long, start_time double, cv_fold int, Response int").repartition(3)
    line = sorted((-1e9 if t is None else t, i, f, y) for i, t, f, y in data)
    mean = sum(y for *_, y in line) / len(line)
    for size, most in ((30, 40), (30, 1 << 19), (120, 25)):
        monkeypatch.setattr(ordering, "ROWS", most)
        got = {x["Id"]: x["rolling_fail_rate"] for x in history.oof_trailing_rate(d, rows=size).collect()}
        for k, i, f, _ in line:
            others = [x for x in line if x[2] != f]
            upto = [n for n, x in enumerate(others) if x[0] <= k]
            before = [x[3] for x in others[max(0, upto[-1] - size) : upto[-1]]] if upto else []
            assert abs(got[i] - (sum(before) / len(before) if before else mean)) < 1e-9


@pytest.mark.parametrize("name", ["frequency", "oof", "as_of", "same_window", "lookup", "encoding"])
def test_heavy_keys_are_spread(spark, monkeypatch, name):
    """90 % of the rows have one key or none; no task of the result has more than three times the median."""
    for key, value in (("start_time", "k"), ("k", "start_time")):
        n = 20_000
        d = spark.range(n).select(F.col("id").alias("Id"), *[F.when(F.col("id") % 10 == 0, F.hash("id").cast("double") if c == "start_time" else F.hash("id").cast("string")).otherwise(None if key == "start_time" else (1.0 if c == "start_time" else "same")).alias(c) for c in ("start_time", "k")], (F.col("id") % 3).alias("m1"), (F.col("id") % 7).alias("score"), (F.col("id") % 5).alias("chunk"), (F.col("id") % 4).cast("int").alias("Response")).repartition(8)
        monkeypatch.setattr(ordering, "MOST_GROUPS", 100)
        monkeypatch.setattr(ordering, "HEAVY", 1000)
        monkeypatch.setattr(encode, "MAP_VALUES", 0)
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            if name == "lookup":
                table = d.select("k").distinct().withColumn("v", F.lit(1.0))
                out = joins.lookup(d, table, "k", "v", spark.createDataFrame([(0.1,)], "g double"), "out")
            elif name == "encoding":
                table = d.where("k is not null").select(F.lit("k").alias("col"), F.col("k").alias("value")).distinct().withColumn("rate", F.lit(0.5))
                out = encode.apply_encoding(d, table, ["k"], spark.createDataFrame([(0.1,)], "g double"))
            else:
                out = CASES[name](d)
            sizes = sorted(x["count"] for x in out.groupBy(F.spark_partition_id().alias("p")).count().collect())
        finally:
            spark.conf.unset("spark.sql.adaptive.enabled")
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        assert sum(sizes) == n and len(sizes) >= 8 and sizes[-1] <= 3 * sizes[len(sizes) // 2]


def test_run_features(parts, monkeypatch):
    monkeypatch.setattr(ordering, "ROWS", 1 << 19)
    r = runs.adjacent_runs(parts.withColumn("start_time", F.col("Id").cast("double")), ["k"]).cache()
    assert r.agg(F.max("run_size")).first()[0] >= 699
    both(monkeypatch, lambda: runs.expanding_mean(r, "score"))
    both(monkeypatch, lambda: runs.run_rank_of(r, "score", "rank"))
    got = {x["Id"]: (x["score_prev"], x["score_next"]) for x in runs.neighbours(r, ["score"]).collect()}
    line = sorted(r.collect(), key=lambda x: x["Id"])
    for a, b in zip(line, line[1:], strict=False):
        assert (got[b["Id"]][0], got[a["Id"]][1]) == ((a["score"], b["score"]) if a["run_id"] == b["run_id"] else (-1.0, -1.0))


def test_no_range_is_large(parts, monkeypatch):
    """90 % of the times and measures are null; still no range holds more than three times its share."""
    monkeypatch.setattr(ordering, "ROWS", MOST)
    for order in (ordering.by_key("start_time", "Id"), ordering.by_key("m1", "Id", descending=True)):
        b, n = ordering.ranges(parts, order)
        sizes = [r["count"] for r in b.groupBy("_b").count().collect()]
        assert n == -(-900 // MOST) and len(sizes) > n // 2 and max(sizes) <= 3 * MOST
    spread = parts.where("m1 is null").select(F.pmod(F.xxhash64("Id"), F.lit(runs.SPREAD)).alias("z")).groupBy("z").count()
    assert spread.agg(F.max("count")).first()[0] < 10


def test_runs_take_linear_time(spark):
    """500,000 rows of one range, nine tenths of them one run, take at most 15 times what 50,000 take; no frame ends at
    the last row."""

    def took(n):
        d = spark.range(n).select(F.col("id").alias("Id"), F.col("id").cast("double").alias("start_time"), F.when(F.col("id") < 0.9 * n, 0).otherwise(F.hash("id") % 7).alias("k")).repartition(8)
        began = time.time()
        got = runs.adjacent_runs(d, ["k"])
        assert got.agg(F.max("run_size"), F.max("run_rank"), F.count("*")).first() == (0.9 * n, 0.9 * n, n)
        # but for the one that is the whole range, which is computed once
        frames = re.findall(r"specifiedwindowframe\(rowframe, (.*?)\)\)?\)? as", got._jdf.queryExecution().optimizedPlan().toString().lower())
        assert frames and not any("unboundedfollowing" in f and "unboundedpreceding" not in f for f in frames)
        return time.time() - began

    took(1000)
    least = took(50_000)
    assert took(500_000) < 15 * max(least, 0.5)


def test_wide_keys_over_ranges(spark, monkeypatch):
    """Keys of many measures meet over a range's edge whole; ranges beyond the bound are not broadcast."""
    d = spark.range(600).select(F.col("id").alias("Id"), F.col("id").cast("double").alias("start_time"), *[F.when(F.col("id") % 97 > i, F.floor(F.col("id") / 50)).alias(f"c{i}") for i in range(12)])
    monkeypatch.setattr(ordering, "MOST_RANGES", 3)
    got = both(monkeypatch, lambda: runs.adjacent_runs(d, [f"c{i}" for i in range(12)]))
    assert len(got) == 600
