"""Out-of-fold training, stacking and scoring with boosted trees (trees.py)."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce
from multiprocessing.pool import ThreadPool
from threading import Lock
from weakref import WeakKeyDictionary

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millwatch.functions import numbers as N
from millwatch.operators import encode, joins, metrics, select, trees
from millwatch.sources import io
from millwatch.sources.io import stored

#: Feature lists of the three base models.
BASELINE = ["start_time", "duration", "feature_mean", "records_last_1hr", "records_last_24hr", "density_ratio", "chunk_id", "chunk_size"]
DATASET_G = [*BASELINE, "chunk_failure_rate", "rolling_fail_rate_w10000", "signature_failure_rate", "duration_x_path_failure_rate", "feature_mean_x_duration"]
DATASET_H = [*BASELINE, "transition_fail_rate_mean", "transition_fail_rate_max", "transition_fail_rate_std", "station_risk_mean", "path_count", "pair_cooccur_mean", "pair_cooccur_max", "pair_cooccur_std"]
META = ["p1", "p2", "p3", "mean_prediction", "std_prediction", "max_prediction", "agreement_count"]


#: Profiles of stored tables, by feature.
_PROFILES: WeakKeyDictionary[DataFrame, dict] = WeakKeyDictionary()


def fill_values(df: DataFrame, features: list[str]) -> dict[str, float]:
    """Each feature's median, one row a feature; 0 for one without values. df is a stored table. What its profiles know is
    not looked for again."""
    told = {f: p for f, p in _PROFILES.get(df, {}).items() if f in features and p.exact}
    left = [f for f in features if f not in told]
    known = {f: p.at(0.5) if len(p.values) else 0.0 for f, p in told.items()}
    doubles = df.select(*[F.col(f).cast("double").alias(f) for f in left])
    return known | {r["col"]: r["median"] for r in (encode.medians(doubles, left, at_hand=True).collect() if left else [])}


class Fills(Mapping):
    """Each feature's median. Those of features that miss values in df, a stored table, are found at once; the others,
    which only other rows can ask for, when one is asked for."""

    def __init__(self, df: DataFrame, features: list[str], told: list[select.Profile]):
        holed = [f for f, p in zip(features, told, strict=True) if p.gaps]
        self.df, self.features, self.lock = df, features, Lock()
        self.known = fill_values(df, holed) if holed else {}

    def __getitem__(self, feature: str) -> float:
        with self.lock:
            if feature not in self.known and feature in self.features:
                self.known |= fill_values(self.df, [f for f in self.features if f not in self.known])
        return self.known[feature]

    def __iter__(self):
        return iter(self.features)

    def __len__(self) -> int:
        return len(self.features)


def _assemble(df: DataFrame, features: list[str], fills: Mapping[str, float]) -> DataFrame:
    """df with the array _x of its features, unless it has that."""
    if "_x" in df.columns:
        return df
    x = lambda f: F.col(f).cast("double")
    return df.withColumn("_x", F.array(*[F.coalesce(F.when(~F.isnan(x(f)), x(f)), F.lit(float(fills.get(f, 0.0)))) for f in features]))


#: Blocks by fold of the rows that several fits share.
_BLOCKS: WeakKeyDictionary[DataFrame, trees.Blocks] = WeakKeyDictionary()


def fit_one(train: DataFrame, features: list[str], fills: Mapping[str, float], target: str = "Response", rounds: int = 20, depth: int = 5, step: float = 0.1, seed: int = 42, stop_share: float = 0.1, stop: Column | None = None, share: float = 0.8) -> trees.Trees:
    """One model with balanced weights, each tree on a share of the rows. The rows of `stop` (a held-out fold; a hashed
    share, if it is left out) aren't trained on and decide when to stop."""
    if stop is None or (blocks := _BLOCKS.get(train)) is None:
        stop = F.pmod(F.xxhash64("Id", F.lit(seed)), F.lit(1000)) < int(1000 * stop_share) if stop is None else stop
        rows = train.withColumn("_stop", F.coalesce(stop, F.lit(False)))
        blocks, stop = trees.pack(rows, features, fills, select.profiles(rows, features), target, "_stop"), F.col("_stop")
    return trees.fit(blocks, F.coalesce(stop, F.lit(False)), rounds, depth, step, seed, share, least_rows=20)


def score(df: DataFrame, model, features: list[str], fills: Mapping[str, float], out: str = "pred") -> DataFrame:
    return _assemble(df, features, fills).withColumn(out, model.probability()).drop("_x")


#: A saved version: each model as text, features, and their fill values.
ABOUT = "models array<string>, features array<string>, fills array<double>"


@dataclass
class Trained:
    """Models, one a fold, with what scoring needs: features in order and fill values."""

    models: list
    features: list[str]
    fills: Mapping[str, float]

    @property
    def version(self) -> str:
        """Prefix of the hash of all that scoring depends on."""
        texts = [m.text() for m in self.models]
        return hashlib.sha256(json.dumps([self.features, sorted(self.fills.items()), texts]).encode()).hexdigest()[:12]

    def save(self, spark: SparkSession, path: str) -> None:
        """As a new version, which readers see when it is whole."""
        told = [([m.text() for m in self.models], self.features, [float(self.fills[f]) for f in self.features])]
        with io.new_version(spark, path) as folder:
            spark.createDataFrame(told, ABOUT).coalesce(1).write.json(f"{folder}/about")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Trained:
        folder = io.last_version(spark, path)
        r = spark.read.schema(ABOUT).json(f"{folder}/about").first()
        return cls([trees.Trees.of(m) for m in r["models"]], r["features"], dict(zip(r["features"], r["fills"], strict=True)))

    def score(self, df: DataFrame, out: str = "predicted_proba") -> DataFrame:
        """df with the mean of the models' probabilities."""
        d = _assemble(df, self.features, self.fills)
        return d.withColumn(out, ensemble([[m.probability()] for m in self.models])).drop("_x")


def train_oof(df: DataFrame, features: list[str], folds: int = 5, target: str = "Response", fold: str = "cv_fold", parallelism: int = 5, **params) -> tuple[DataFrame, Trained]:
    """(Id, Response, oof_pred, cv_fold) and the models: each fold is scored by a model of the others, whose rounds end
    where the loss on that fold does. Folds are a fixed few; some are fitted at a time, each fit being Spark jobs. Rows and
    their blocks are stored by fold, once for all fits; rows that the caller has stored so are taken as they are."""
    slim = df.select("Id", target, fold, *features)
    slim = slim if io.stored_by(df) == [fold] else stored(slim, "train", by=[fold])
    told = select.profiles(slim, features)
    _PROFILES[slim] = dict(zip(features, told, strict=True))
    fills = Fills(slim, features, told)
    rows = _assemble(slim, features, fills.known)
    if folds > 1:
        _BLOCKS[rows] = trees.pack(slim, features, fills.known, told, target, fold)
    fit = lambda k: fit_one(rows, features, fills, target, stop=F.col(fold) == k if folds > 1 else None, **params)
    with ThreadPool(min(parallelism, folds)) as pool:
        models = pool.map(inheritable_thread_target(rows.sparkSession)(fit), range(folds)) if folds > 1 else [fit(0)]
    out = [score(rows.where(F.col(fold) == k), m, features, fills, "oof_pred").select("Id", target, "oof_pred", fold) for k, m in enumerate(models)]
    return reduce(DataFrame.unionByName, out), Trained(models, features, fills)


def importance(spark: SparkSession, trained: Trained) -> DataFrame:
    """(feature, importance) over the models' mean, the highest first."""
    rows = [(k, f, float(v)) for k, m in enumerate(trained.models) for f, v in zip(trained.features, m.importances(), strict=True)]
    return spark.createDataFrame(rows, "fold int, feature string, v double").groupBy("feature").agg(F.avg("v").alias("importance")).orderBy(F.desc("importance"), "feature")


def fold_report(oof: DataFrame, target: str = "Response", fold: str = "cv_fold") -> DataFrame:
    """(scope, rows, threshold, mcc): rows and the best threshold of each fold, and overall."""
    # each row twice, made once
    scopes = F.array(F.concat(F.lit("fold "), F.col(fold).cast("string")), F.lit("overall"))
    every = oof.select(F.explode(scopes).alias("scope"), target, "oof_pred")
    every = stored(every, "oof")
    best = metrics.best_threshold(metrics.threshold_sweep(every, target, "oof_pred", by=["scope"]), by=["scope"])
    return every.groupBy("scope").agg(F.count("*").alias("rows")).join(best, "scope").select("scope", "rows", "threshold", "mcc")


def summary(oof: DataFrame, name: str, target: str = "Response", fold: str = "cv_fold") -> DataFrame:
    """One row of a training summary: model, rows, folds, the best overall threshold with its mcc, and each fold's rows,
    threshold and mcc."""
    report = stored(fold_report(oof, target, fold), "report")
    each = F.col("scope") != "overall"
    detail = F.sort_array(F.collect_list(F.when(each, F.struct("scope", "rows", "threshold", "mcc"))))
    one = lambda c: F.max(F.when(~each, F.col(c))).alias(c)
    return report.agg(F.lit(name).alias("model"), one("rows"), F.count_if(each).alias("folds"), one("threshold"), one("mcc"), detail.alias("by_fold"))


def record(oof: DataFrame, name: str, path: str, target: str = "Response", fold: str = "cv_fold") -> DataFrame:
    """Puts a model's row into the summary at path, in place of an earlier one of its name, and gives the whole summary."""
    return io.update_summary(summary(oof, name, target, fold), path, "model")


def stack(bases: dict[str, DataFrame], groups: DataFrame) -> DataFrame:
    """Out-of-fold scores of base models (Id, Response, oof_pred) as one table with the meta features, each base score
    counted from its own best threshold on; groups: (Id, chunk_id, cv_fold)."""
    names, limits, tables = [f"p{i}" for i in range(1, len(bases) + 1)], [], [groups]
    for i, (name, oof) in enumerate(zip(names, bases.values(), strict=True)):
        limits.append(metrics.best_threshold(metrics.threshold_sweep(oof, score="oof_pred")).first()["threshold"])
        tables.append(oof.select("Id", *(["Response"] if i == 0 else []), F.col("oof_pred").alias(name)))
    return meta_features(joins.all_to_one(tables), names, limits)


def meta_features(df: DataFrame, scores: list[str], thresholds: list[float] | None = None) -> DataFrame:
    """mean, deviation (population), maximum and agreement of base scores."""
    t = thresholds or [0.5] * len(scores)
    n, cols = len(scores), [F.col(c) for c in scores]
    mean = N.add(cols) / n
    var = N.add([(c - F.col("mean_prediction")) * (c - F.col("mean_prediction")) for c in cols]) / n
    out = df.withColumn("mean_prediction", mean)
    return out.withColumns({"std_prediction": F.sqrt(var), "max_prediction": F.greatest(*cols), "agreement_count": N.add([(c >= x).cast("int") for c, x in zip(cols, t, strict=True)])})


def ensemble(by_fold: list[list[Column]]) -> Column:
    """Mean over a fold's seeds, then over folds."""
    return N.add([N.add(seeds) / len(seeds) for seeds in by_fold]) / len(by_fold)


def route(df: DataFrame, first: str, second: str, size: str = "run_size", threshold: float = 0.5, zero_single: bool = False) -> DataFrame:
    """final_predicted_proba: the second stage's score in runs of several rows, else the first's (or 0); and its label."""
    p = F.when(F.col(size) > 1, F.col(second)).otherwise(F.lit(0.0) if zero_single else F.col(first))
    return df.withColumn("final_predicted_proba", p).withColumns({"predicted_label": (F.col("final_predicted_proba") >= threshold).cast("int"), "is_duplicate_row": (F.col(size) > 1).cast("int")})


def predictions(df: DataFrame, score_col: str, features: list[str], version: str, threshold: float = 0.5) -> DataFrame:
    """Prediction rows: probability, label, time, model version, features used and missing."""
    here = [f for f in features if f in df.columns]
    gone = N.add([F.lit(0), *[F.col(f).isNull().cast("int") for f in here]]) + (len(features) - len(here))
    return df.select("Id", F.col(score_col).alias("predicted_proba"), (F.col(score_col) >= threshold).cast("int").alias("predicted_label"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("prediction_timestamp"), F.lit(version).alias("model_version"), F.lit(len(here)).alias("n_features_used"), gone.alias("missing_features_count"))
