"""Selection by nested histograms against sorting."""

import math
import random

import pytest
from pyspark.sql import functions as F

from millwatch.operators import decide, encode, metrics, select


def spread(r, n):
    """Values of all magnitudes, many equal, with both zeros, infinities, NaN and nulls."""
    pick = [lambda: None, lambda: math.nan, lambda: 0.5, lambda: -0.0, lambda: r.random(), lambda: r.choice([-1, 1]) * 10 ** r.uniform(-320, 300), lambda: math.inf, lambda: -math.inf, lambda: 1.0 + r.randint(0, 3) * 2**-52]
    return [r.choice(pick)() for _ in range(n)]


@pytest.mark.parametrize("few, bins, columns", [(1 << 16, 4096, 16), (0, 4096, 16), (0, 4096, 0), (3, 2, 16)])
def test_places(spark, monkeypatch, few, bins, columns):
    monkeypatch.setattr(select, "FEW", few)
    monkeypatch.setattr(select, "FEW_COLUMNS", columns)
    monkeypatch.setattr(select, "BINS", bins)
    r = random.Random(few + bins)
    n = 700 if bins > 2 else 60
    cols = {"a": spread(r, n), "b": [r.random() for _ in range(n)], "c": [None] * n, "d": [7.0] * n}
    df = spark.createDataFrame(list(zip(*cols.values(), strict=True)), "a double, b double, c double, d double").repartition(5)
    got = select.places(df, list(cols), lambda m: {k: k for k in (0, m // 3, m // 2, m - 1)})
    for c, values in cols.items():
        line = sorted(v for v in values if v is not None and not math.isnan(v))
        for k in {0, len(line) // 3, len(line) // 2, len(line) - 1} if line else ():
            p = got[c, k]
            assert p.value == line[k] and p.below == sum(v < line[k] for v in line) and p.equal == line.count(line[k])
    assert not any(c == "c" for c, _ in got)


def test_whole_numbers(spark, monkeypatch):
    """Neighbours beyond 2 ** 53 are told apart."""
    monkeypatch.setattr(select, "FEW", 0)
    line = sorted([(1 << 62) + k for k in range(50)] + [-(1 << 62) - k for k in range(50)] + [0, 1, 1])
    df = spark.createDataFrame([(v,) for v in line], "i long")
    got = select.places(df, ["i"], lambda m: {k: k for k in range(m)}, "bigint")
    assert [got["i", k].value for k in range(len(line))] == line


@pytest.mark.parametrize("seed", range(3))
def test_budgets(spark, monkeypatch, seed):
    monkeypatch.setattr(select, "FEW", 5)
    r = random.Random(seed)
    scores = spread(r, 300) if seed < 2 else [r.choice([0.1, 0.2, 0.7]) for _ in range(300)]
    ids = r.sample(range(-1000, 1000), 300)
    df = spark.createDataFrame([(i, s, r.randint(0, 1)) for i, s in zip(ids, scores, strict=True)], "Id long, pred double, Response int").repartition(4)
    order = lambda t: (t[1] is None, 0 if t[1] is None else -math.inf if math.isnan(t[1]) else -t[1], 0 if t[1] is None or not math.isnan(t[1]) else -1, t[0])
    nan_first = sorted(zip(ids, scores, strict=True), key=lambda t: (t[1] is None, not (t[1] is not None and math.isnan(t[1])), order(t)))
    for percent in (0, 0.1, 5, 33, 60, 99, 100):
        k = math.ceil(300 * percent / 100)
        assert {x[0] for x in decide.top_budget(df, percent).where("inspect = 1").select("Id").collect()} == {i for i, _ in nan_first[:k]}
    label = {x["Id"]: x["Response"] for x in df.collect()}
    for row in metrics.budget_curve(df, percents=(1, 2, 5, 10, 50, 90, 100)).collect():
        k = metrics.percent_rows(300, row["inspection_budget_pct"])
        last = nan_first[k - 1][1]
        same = row["score_cutoff"] == last or (last is not None and row["score_cutoff"] is not None and math.isnan(last) and math.isnan(row["score_cutoff"]))
        assert row["selected_rows"] == k and same and row["tp"] == sum(label[i] for i, _ in nan_first[:k])
        assert row["tp"] + row["fp"] == k and row["fn"] == sum(label.values()) - row["tp"] and row["tp"] + row["fp"] + row["fn"] + row["tn"] == 300


def test_no_scores(spark):
    none = spark.createDataFrame([], "Id long, pred double, Response int")
    assert decide.hybrid(none).count() == 0 and metrics.budget_curve(none).where("selected_rows > 0").count() == 0
    assert encode.percentiles(none, ["pred"], [0.5]).count() == 0


def test_many_columns_shuffle_bins_only(spark):
    """Medians of 300 columns: no shuffle has a row for each value."""
    n, names = 3000, [f"c{i}" for i in range(300)]
    df = spark.range(n).select(*[(F.hash("id", F.lit(i)) / 1000.0).alias(c) for i, c in enumerate(names)]).repartition(4)
    first = select._bins(select._values(df, names, range(len(names)), "double"), select._coarse(F.col("x")), ["c"])
    assert first.count() < 300 * 50
    got = {r["col"]: r["median"] for r in encode.medians(df, names).collect()}
    want = df.agg(*[F.percentile(c, F.lit(0.5)).alias(c) for c in names]).first()
    assert all(abs(got[c] - want[c]) < 1e-9 * max(1, abs(want[c])) for c in names)
