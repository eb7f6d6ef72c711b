"""Rows that a state was fitted on get its features once, lie by fold for training, and are profiled in one pass."""

import numpy as np
from pyspark.sql import functions as F

from millwatch.operators import encode, model, select, state
from millwatch.sources import io

STATIONS = state.Stations(("L0_S1",), ("L0_S1", "L1_S2"), ("L0_S1",))


def test_known_once(spark, monkeypatch):
    """transform() of the rows of fit_known() is that of raw rows, without making what it knows again."""
    rows = [(i, int(i % 7 == 0), float(i % 11), None if i % 4 == 0 else float(i % 5), float(i % 30) if i % 9 else None, float(i % 30 + 3) if i % 5 else None, "ab"[i % 2]) for i in range(120)]
    parts = spark.createDataFrame(rows, "Id long, Response int, L0_S1_F1 double, L1_S2_F1 double, L0_S1_D1 double, L1_S2_D1 double, L0_S1_C1 string").cache()
    made = state.raw(parts, STATIONS)
    fitted, known = state.fit_known(parts, stations=STATIONS, made=made)
    want = state.transform(parts.drop("Response"), fitted, parts, stations=STATIONS, made=made)[0]
    want = {r["Id"]: r for r in want.collect()}
    monkeypatch.setattr(state, "_known", None)
    got, _ = state.prepare(parts.drop("Response"), fitted, parts, stations=STATIONS, made=known, carry=("Response",), folds=F.pmod("Id", F.lit(3)))
    assert io.stored_by(got) == ["cv_fold"] and got.count() == 120
    for r in got.collect():
        assert r["Response"] == int(r["Id"] % 7 == 0) and r["cv_fold"] == r["Id"] % 3
        assert all(r[c] == v for c, v in want[r["Id"]].asDict().items())


def test_rows_by_fold_are_taken(spark, monkeypatch):
    """Training stores no rows that lie by fold already."""
    names, whole = [], model.stored
    monkeypatch.setattr(model, "stored", lambda df, name="t", by=None: names.append(name) or whole(df, name, by))
    df = spark.range(300).select(F.col("id").alias("Id"), (F.col("id") % 2).cast("int").alias("Response"), (F.col("id") % 3).alias("cv_fold"), (F.col("id") % 17).cast("double").alias("a"))
    lying = io.stored(df, "rows", by=["cv_fold"])
    assert model.train_oof(lying, ["a"], 3, rounds=1, depth=1)[0].count() == 300 and not names
    assert model.train_oof(df, ["a"], 3, rounds=1, depth=1)[0].count() == 300 and names == ["train"]


def test_profiles(spark, monkeypatch):
    """Of many columns percentiles are exact, where values are few, many, missing or infinite; and read whole once."""
    monkeypatch.setattr(select, "POINTS", 64)
    monkeypatch.setattr(select, "HELD", 256)
    monkeypatch.setattr(select, "FEW", 50)
    n, rng = 3000, np.random.default_rng(5)
    kinds = [lambda: rng.integers(0, 5, n).astype(float), lambda: rng.normal(size=n) * 1e3, lambda: np.where(rng.random(n) < 0.3, np.nan, rng.normal(size=n)), lambda: np.where(rng.random(n) < 0.6, np.inf, rng.normal(size=n)), lambda: np.full(n, np.nan)]
    table = np.stack([kinds[i % 5]() for i in range(20)])
    cols = [f"c{i}" for i in range(20)]
    df = spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in row) for row in table.T], ", ".join(f"{c} double" for c in cols)).repartition(4).cache()
    told = select.profiles(df, cols)
    for x, p in zip(table, told, strict=True):
        here = np.sort(x[~np.isnan(x)])
        assert p.gaps == n - len(here) and p.rows.sum() == len(here) and p.exact == (len(np.unique(here)) <= 64)
        upto = np.cumsum(p.rows)
        assert all(abs(np.searchsorted(here, v, "right") - k) <= n // 8 for v, k in zip(p.values, upto, strict=True))
    got = {(r["col"], r["share"]): r["value"] for r in encode.percentiles(df, cols, [0.1, 0.5], at_hand=True).collect()}
    for c, x in zip(cols, table, strict=True):
        here = np.sort(x[~np.isnan(x)])
        for q in (0.1, 0.5):
            rank = q * (len(here) - 1)
            if len(here):
                a, b, f = here[int(np.floor(rank))], here[int(np.ceil(rank))], rank - np.floor(rank)
                assert got[c, q] == (a if a == b else a * (1 - f) + b * f)
            else:
                assert (c, q) not in got
