"""Fitting and applying a state make the features of the rows once, whatever their width, and share them."""

import pytest
from pyspark.sql import functions as F

from millwatch.operators import ordering, runs, state

STATIONS = state.Stations(("L0_S1",), ("L0_S1", "L1_S2"), ("L0_S1",))


@pytest.fixture(scope="module")
def parts(spark):
    """Ids repeat and are null now and then, so that rows are told apart by no column."""
    rows = [(None if i % 50 == 7 else i // 2, int(i % 7 == 0), float(i % 11), None if i % 4 == 0 else float(i % 5), float(i % 30) if i % 9 else None, float(i % 30 + 3), "ab"[i % 2]) for i in range(200)]
    return spark.createDataFrame(rows, "Id long, Response int, L0_S1_F1 double, L1_S2_F1 double, L0_S1_D1 double, L1_S2_D1 double, L0_S1_C1 string").cache()


def test_made_once(spark, parts):
    """Fit and transform over one raw() read each row once."""
    seen = spark.sparkContext.accumulator(0)

    def told(x):
        seen.add(1)
        return x

    d = parts.withColumn("L0_S1_F1", F.udf(told, "double")("L0_S1_F1"))
    made = state.raw(d, STATIONS)
    fitted = state.fit(d, stations=STATIONS, made=made)
    state.transform(parts.drop("Response"), fitted, parts, stations=STATIONS, made=made)[0].collect()
    assert seen.value == parts.count()


@pytest.mark.parametrize("rows", [1 << 19, 40])
def test_every_row_stays(spark, monkeypatch, parts, rows):
    """Blocks meet rows by number: repeated and null ids neither multiply nor drop any, in one range and in several."""
    monkeypatch.setattr(ordering, "ROWS", rows)
    made = state.raw(parts, STATIONS)
    assert made.rows.columns == [*parts.columns, *made.made]
    assert made.rows.select(parts.columns).exceptAll(parts).count() == 0 == parts.exceptAll(made.rows.select(parts.columns)).count()
    assert made.rows.count() == parts.count()


def test_prepared_rows_are_taken(monkeypatch, parts):
    """Rows that the caller has prepared are not prepared again."""
    import types

    from millwatch.operators import predict

    def no(*args):
        raise AssertionError("prepared again")

    monkeypatch.setattr(state, "prepare", no)
    features = parts.select("Id", F.col("L0_S1_F1").alias("f"))
    stub = types.SimpleNamespace(features=["f"], version="v", score=lambda df, out: df.withColumn(out, F.col("f") / 10))
    out, info = predict.predict(None, None, stub, prepared=(features, {"missing_features": []}))
    assert out.count() == parts.count() and not info["missing_features"]
    assert {r["predicted_label"] for r in out.collect()} == {0, 1}
