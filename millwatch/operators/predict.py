"""Raw rows to predictions: fitted features, an ensemble of models, and a second stage for runs of duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millwatch.operators import model, runs, state
from millwatch.sources.io import stored

BASE, SECOND = "base_predicted_proba", "batch_predicted_proba"
#: Features of the second stage beside those of the first.
RUN_FEATURES = [
    *[f"{BASE}_{x}" for x in ("prev", "next", "prev_missing", "next_missing", "delta_prev", "delta_next")],
    *[f"duration_{x}" for x in ("prev", "next", "prev_missing", "next_missing", "delta_prev", "delta_next")],
    "position", "position_from_end", "position_ratio", "is_run_start", "is_run_end", "prev_score_mean", "run_score_mean", "run_score_max", "run_score_std", "run_duration_mean", "run_duration_range", "score_rank", "duration_rank",
]


#: What run_features() reads beside the score.
RUN_COLUMNS = ["Id", "run_id", "run_size", "run_rank", "run_rank_desc", "duration"]


def run_features(rows: DataFrame, score: str = BASE) -> DataFrame:
    """rows (of runs) with what the other rows of their run say: neighbours, positions, statistics and ranks."""
    d = runs.positions(runs.neighbours(rows, [score, "duration"]))
    d = stored(runs.run_statistics(runs.expanding_mean(d, score), score), "run_features")
    return runs.run_rank_of(runs.run_rank_of(d, score, "score_rank"), "duration", "duration_rank")


def predict(df: DataFrame, fitted: state.State, models: model.Trained, context: DataFrame | None = None, allow_fallback: bool = True, threshold: float = 0.5, stations: state.Stations = state.Stations(), prepared: tuple[DataFrame, dict] | None = None) -> tuple[DataFrame, dict]:
    """(Id, predicted_proba, predicted_label, prediction_timestamp, model_version, n_features_used,
    missing_features_count) of raw rows, and what preparing them had to say. prepared: what state.prepare() gave for the
    same rows, where the caller has it."""
    features, info = prepared or state.prepare(df, fitted, context, allow_fallback, stations)
    scored = models.score(features, "_score")
    out = model.predictions(scored, "_score", models.features, models.version, threshold)
    return out.withColumn("missing_features_count", F.col("missing_features_count") + len(info["missing_features"])), info


def train_second(features: DataFrame, oof: DataFrame, folds: int = 5, **params) -> tuple[DataFrame, model.Trained]:
    """The second stage: trained on rows of runs with several rows, from the first stage's out-of-fold scores. features:
    prepared rows; oof: (Id, Response, oof_pred, cv_fold)."""
    rows = features.where("run_size > 1").select(*RUN_COLUMNS).join(oof.select("Id", "Response", "cv_fold", F.col("oof_pred").alias(BASE)), "Id")
    return model.train_oof(run_features(stored(rows, "second")), [*RUN_FEATURES, BASE], folds, **params)


def predict_two_stage(df: DataFrame, fitted: state.State, first: model.Trained, second: model.Trained, context: DataFrame | None = None, allow_fallback: bool = True, threshold: float = 0.5, zero_single: bool = False, stations: state.Stations = state.Stations(), prepared: tuple[DataFrame, dict] | None = None) -> tuple[DataFrame, dict]:
    """Predictions of both stages: rows of runs with several rows get the second's score, others the first's (or 0). Scores
    meet their rows by Id. prepared: as predict() takes it."""
    features, info = prepared or state.prepare(df, fitted, context, allow_fallback, stations)
    asked = [c for c in second.features if c in features.columns and c not in RUN_COLUMNS]
    base = stored(first.score(features, BASE).select(*RUN_COLUMNS, BASE, *asked), "base")
    batch = second.score(run_features(base.where("run_size > 1")), SECOND).select("Id", SECOND)
    rows = model.route(base.join(batch, "Id", "left"), BASE, SECOND, threshold=threshold, zero_single=zero_single)
    told = (F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("prediction_timestamp"), F.lit(f"{first.version}-{second.version}").alias("model_version"), F.lit(len(info["missing_features"])).alias("missing_features_count"))
    return rows.select("Id", BASE, SECOND, "final_predicted_proba", "predicted_label", "is_duplicate_row", *told), info
