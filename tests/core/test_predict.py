"""Raw rows to labels: fitted state and models saved, loaded and applied, in one stage and in two."""

import pytest
from pyspark.sql import functions as F

from millwatch.operators import model, predict, runs, state
from millwatch.sources import io

FEW = {"rounds": 2, "depth": 2}
STATIONS = state.Stations(("L0_S1",), ("L0_S1", "L1_S2"), ("L0_S1",))


@pytest.fixture(scope="module")
def parts(spark):
    """Parts in runs of equal measures; parts of long runs fail more often."""
    rows = []
    for i in range(600):
        k = i // 3 if i % 6 < 3 else 1000 + i
        v = float((k * 37) % 101)
        rows.append((i, int(v > 80 or i % 53 == 0), v, None if k % 4 == 0 else v / 2, float(i) if i % 9 else None, float(i + 3), "ab"[k % 2] if i % 5 else None))
    return spark.createDataFrame(rows, "Id long, Response int, L0_S1_F1 double, L1_S2_F1 double, L0_S1_D1 double, L1_S2_D1 double, L0_S1_C1 string").cache()


def test_end_to_end(spark, parts, tmp_path):
    state.fit(parts, stations=STATIONS).save(f"{tmp_path}/state")
    fitted = state.State.load(spark, f"{tmp_path}/state")
    raw = parts.drop("Response")
    features, info = state.prepare(raw, fitted, parts, stations=STATIONS)
    assert info["temporal_context_used"] and not info["warnings"] and not info["missing_features"]
    assert features.columns == ["Id", *[n for n, _, _ in fitted.columns()]] and features.count() == 600
    names = [n for n, kind, _ in fitted.columns() if kind != "string"]
    folded = features.join(parts.select("Id", "Response"), "Id").withColumn("cv_fold", (F.col("Id") % 2).cast("int"))
    oof, first = model.train_oof(folded, names, 2, **FEW)
    first.save(spark, f"{tmp_path}/first")
    again = model.Trained.load(spark, f"{tmp_path}/first")
    assert again.version == first.version and again.features == names
    out, _ = predict.predict(raw, fitted, again, parts, stations=STATIONS)
    rows = {r["Id"]: r for r in out.collect()}
    want = {r["Id"]: r["p"] for r in first.score(features, "p").collect()}
    assert len(rows) == 600 and all(abs(rows[i]["predicted_proba"] - p) < 1e-12 and rows[i]["predicted_label"] == int(p >= 0.5) for i, p in want.items())
    assert {r["model_version"] for r in rows.values()} == {first.version} and {r["missing_features_count"] for r in rows.values()} == {0}
    report = {r["scope"]: r for r in model.fold_report(oof).collect()}
    assert set(report) == {"fold 0", "fold 1", "overall"} and report["overall"]["rows"] == 600 == report["fold 0"]["rows"] + report["fold 1"]["rows"]
    assert report["overall"]["mcc"] > 0.3
    # two stages
    _, second = predict.train_second(features, oof, 2, **FEW)
    both, _ = predict.predict_two_stage(raw, fitted, again, second, parts, stations=STATIONS)
    for r in both.join(features.select("Id", "run_size"), "Id").collect():
        assert r["is_duplicate_row"] == int(r["run_size"] > 1) and (r[predict.SECOND] is None) == (r["run_size"] == 1)
        assert r["final_predicted_proba"] == (r[predict.SECOND] if r["run_size"] > 1 else r[predict.BASE])
    zero, _ = predict.predict_two_stage(raw, fitted, again, second, parts, zero_single=True, stations=STATIONS)
    assert {r[0] for r in zero.where("is_duplicate_row = 0").select("final_predicted_proba").distinct().collect()} == {0.0}


def test_history_fallback(spark, parts):
    fitted = state.fit(parts, stations=STATIONS)
    raw, medians = parts.drop("Response"), {r["col"]: r["median"] for r in fitted.medians.collect()}
    for context in (None, parts.where("Response = 0")):
        out, info = state.transform(raw, fitted, context, stations=STATIONS)
        assert info["temporal_fallback_used"] and len(info["warnings"]) == 1
        assert {r[0] for r in out.select("since_last_5").distinct().collect()} == {medians["since_last_5"]}
        with pytest.raises(ValueError, match="switched off"):
            state.transform(raw, fitted, context, allow_fallback=False, stations=STATIONS)
    with pytest.raises(ValueError, match="Response"):
        state.transform(raw, fitted, raw, stations=STATIONS)
    # a table without one of the stations keeps the contract
    less, info = state.transform(raw.drop("L1_S2_F1"), fitted, parts, stations=STATIONS)
    assert less.columns == ["Id", *[n for n, _, _ in fitted.columns()]] and "L1_S2_concat_count" in info["missing_features"]


def test_blocks_are_the_operators(spark, parts):
    """The composed features are those of the operators they are made of."""
    fitted = state.fit(parts, stations=STATIONS)
    got = {r["Id"]: r for r in state.transform(parts.drop("Response"), fitted, parts, stations=STATIONS)[0].collect()}
    t = parts.withColumn("start_time", F.least("L0_S1_D1", "L1_S2_D1"))
    for r in runs.adjacent_runs(t, ["L0_S1_F1", "L1_S2_F1"]).collect():
        assert (got[r["Id"]]["is_duplicate"], got[r["Id"]]["run_size"], got[r["Id"]]["run_rank"]) == (r["is_duplicate"], r["run_size"], r["run_rank"])
    for r in runs.station_duplicates(t, {"L0_S1": ["L0_S1_F1"]}).collect():
        assert got[r["Id"]]["L0_S1_dup_count"] == r["L0_S1_dup_count"]
    rates = {r["path_signature"]: r["rate"] for r in fitted.paths.collect()}
    assert all(abs(r["path_failure_rate"] - rates[r["path_signature"]]) < 1e-12 for r in got.values())


def test_narrowest(spark):
    df = spark.createDataFrame([(-128, 127, 128, 40000, 1 << 40, None), (0, 0, -3, 1, 2, None)], "a long, b long, c long, d long, e long, f long")
    kinds = io.narrowest(df, list("abcdef"))
    assert kinds == {"a": "tinyint", "b": "tinyint", "c": "smallint", "d": "int", "e": "bigint", "f": "tinyint"}
    assert io.optimize_types(df, kinds).collect() == df.collect()


def test_nulls_are_counted_while_writing(spark, parts, monkeypatch):
    """A prepared table tells its rows and nulls without being read again, and names the features that hold nulls."""
    fitted = state.fit(parts, stations=STATIONS)
    out, info = state.prepare(parts.drop("Response"), fitted, parts, stations=STATIONS)
    assert info["rows"] == out.count() == parts.count()
    whole = state.transform

    def holes(*args):
        made, told = whole(*args)
        return made.withColumn("duration", F.when(F.col("Id") % 2 == 0, F.col("duration"))), told

    monkeypatch.setattr(state, "transform", holes)
    with pytest.raises(ValueError, match="'nulls', 'duration'"):
        state.prepare(parts.drop("Response"), fitted, parts, stations=STATIONS)
