"""Queries of datasets, models, drift and quality."""

from __future__ import annotations

from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import functions as F

from millwatch.operators import drift, metrics, model, predict, quality, state
from millwatch.plans import datasets
from millwatch.plans import fixtures as X
from millwatch.plans.q_rows import CATALOG, D_COLS, SIGNED, START, _scratch, parts
from millwatch.plans.q_stats import _COST, A6, A7, O3, R6, TABLE, counts_sql, folds_sql, oof_sql, rates_sql, table, tokens_sql
from millwatch.plans.q_windows import B, R, S, batch_rows, run_rows
from millwatch.plans.registry import query
from millwatch.sources.io import stored
from millwatch.streaming import replay

_F = 'list_filter([' + ", ".join(f'"{c}"' for c in X.NUMERIC) + "], lambda x: x IS NOT NULL)"


#: Parts of a time chunk: small enough that the smallest input has more chunks than folds.
CHUNK = 100


def _roll(w: float) -> str:
    return f'count(*) OVER (ORDER BY ft RANGE BETWEEN {w} PRECEDING AND CURRENT ROW) - count(*) OVER (PARTITION BY ft) + row_number() OVER (PARTITION BY ft ORDER BY "Id")'


BASE = f"""{X.PARTS}, {SIGNED}, {START}, core0 AS (SELECT s."Id", s."Response", start_time, duration, coalesce(list_avg({_F}), 0) AS feature_mean, path_signature,
    coalesce(start_time, min(start_time) OVER () - 1) AS ft FROM starts s JOIN parts p ON s."Id" = p."Id" JOIN signed g ON s."Id" = g."Id"),
  core1 AS (SELECT *, count(*) OVER (PARTITION BY path_signature) AS path_count, CAST({_roll(1.0)} AS INTEGER) AS records_last_1hr, CAST({_roll(24.0)} AS INTEGER) AS records_last_24hr,
    CAST((row_number() OVER (ORDER BY ft, "Id") - 1) // {CHUNK} AS INTEGER) AS chunk_id FROM core0),
  base AS (SELECT *, count(*) OVER (PARTITION BY chunk_id) AS chunk_size, records_last_1hr / greatest(records_last_24hr, 1)::DOUBLE AS density_ratio FROM core1)"""
_BASE_COLS = ["Id", "Response", "start_time", "duration", "records_last_1hr", "records_last_24hr", "chunk_id", "chunk_size", "path_signature", "path_count"]
_quoted = lambda cols: ", ".join(f'"{c}"' for c in cols)


@query("m11_baseline", f"WITH {BASE} SELECT {_quoted(_BASE_COLS)}, {R6(['feature_mean', 'density_ratio'])} FROM base")
def m11(spark, sf_dir):
    return datasets.baseline(parts(spark, sf_dir), X.NUMERIC, X.DATES, chunk=CHUNK).select(*_BASE_COLS, *[F.round(c, 6).alias(c) for c in ("feature_mean", "density_ratio")])


FBASE = f"""{BASE}, {folds_sql("base", "chunk_id")}, fparts AS (SELECT b.*, f.cv_fold FROM base b JOIN folds f ON b.chunk_id = f.grp), g AS (SELECT avg("Response") AS g FROM fparts)"""
ROLL = """tk AS (SELECT coalesce(start_time, -1e9) AS k, "Id", "Response", cv_fold FROM fparts), tr0 AS (SELECT x.f, k, "Id", "Response" FROM tk, (SELECT DISTINCT cv_fold AS f FROM fparts) x WHERE cv_fold <> x.f),
  rl AS (SELECT f, k, "Id", coalesce(avg("Response") OVER (PARTITION BY f ORDER BY k, "Id" ROWS BETWEEN 10000 PRECEDING AND 1 PRECEDING), g) AS r FROM tr0, g), rm AS (SELECT f, k, arg_max(r, "Id") AS r FROM rl GROUP BY 1, 2),
  rolled AS (SELECT tk."Id", rm.r FROM tk ASOF LEFT JOIN rm ON tk.cv_fold = rm.f AND tk.k >= rm.k)"""
_GCOLS = ["chunk_failure_rate", "rolling_fail_rate_w10000", "signature_failure_rate", "path_failure_rate", "duration_x_path_failure_rate"]


@query("m12_dataset_g", f"""WITH {FBASE}, {ROLL}, {oof_sql("path_signature")}, {oof_sql("chunk_id", out="oofc")}, d AS (SELECT p."Id", cv_fold, duration, feature_mean, coalesce(oofc.r, g) AS chunk_failure_rate, coalesce(rolled.r, g) AS rolling_fail_rate_w10000, coalesce(oof.r, g) AS signature_failure_rate
    FROM fparts p JOIN rolled ON p."Id" = rolled."Id" LEFT JOIN oof ON p.path_signature = oof.k AND p.cv_fold = oof.f LEFT JOIN oofc ON p.chunk_id = oofc.k AND p.cv_fold = oofc.f, g),
  e AS (SELECT *, signature_failure_rate AS path_failure_rate, duration * signature_failure_rate AS duration_x_path_failure_rate FROM d)
  SELECT "Id", cv_fold, {R6(_GCOLS)}, round(feature_mean * duration + 1e-7, 2) AS feature_mean_x_duration FROM e""")
def m12(spark, sf_dir):
    b = datasets.baseline(parts(spark, sf_dir), X.NUMERIC, X.DATES, chunk=CHUNK)
    d = datasets.dataset_g(datasets.with_folds(b))
    return d.select("Id", "cv_fold", *[F.round(c, 6).alias(c) for c in _GCOLS], F.round(F.col("feature_mean_x_duration") + 1e-7, 2).alias("feature_mean_x_duration"))


_ST = tokens_sql("k", "st")
_SA = "sx AS (SELECT path_signature, cv_fold, unnest(k) AS token FROM sf), sm AS (SELECT path_signature, cv_fold, avg(coalesce(r, g)) AS sr FROM sx LEFT JOIN st ON sx.token = st.token AND sx.cv_fold = st.f, g GROUP BY 1, 2)"
_HCOLS = ["transition_fail_rate_mean", "transition_fail_rate_max", "transition_fail_rate_std", "station_risk_mean", "pair_cooccur_mean", "pair_cooccur_max", "pair_cooccur_std"]


@query("m13_dataset_h", f"""WITH {FBASE.rpartition(', g AS')[0]}, {A6}, {_ST}, {_SA}, {A7}
  , d AS (SELECT p."Id", p.cv_fold, p.path_count, coalesce(sa.m, g) AS transition_fail_rate_mean, coalesce(sa.x, g) AS transition_fail_rate_max, coalesce(sa.d, 0) AS transition_fail_rate_std, coalesce(sm.sr, g) AS station_risk_mean,
    coalesce(ps.a, 0) AS pair_cooccur_mean, coalesce(ps.b, 0)::DOUBLE AS pair_cooccur_max, coalesce(ps.c, 0) AS pair_cooccur_std
    FROM fparts p LEFT JOIN sa ON p.path_signature = sa.path_signature AND p.cv_fold = sa.cv_fold LEFT JOIN sm ON p.path_signature = sm.path_signature AND p.cv_fold = sm.cv_fold LEFT JOIN ps ON p.path_signature = ps.path_signature, g)
  SELECT "Id", cv_fold, path_count, {R6(_HCOLS)} FROM d""")
def m13(spark, sf_dir):
    b = datasets.baseline(parts(spark, sf_dir), X.NUMERIC, X.DATES, chunk=CHUNK)
    return datasets.dataset_h(datasets.with_folds(b)).select("Id", "cv_fold", "path_count", *[F.round(c, 6).alias(c) for c in _HCOLS])


def _small(spark, sf_dir, once=True):
    """Baseline with folds, for training; once: one model's rows are all that is read."""
    return datasets.with_folds(datasets.baseline(parts(spark, sf_dir), X.NUMERIC, X.DATES, chunk=CHUNK), once=once)


@query("m3_train_oof")
def m3(spark, sf_dir):
    return model.train_oof(_small(spark, sf_dir), model.BASELINE)[0]


@query("m3_report")
def m3_report(spark, sf_dir):
    return model.fold_report(model.train_oof(_small(spark, sf_dir), model.BASELINE)[0])


_SCORED = lambda col, scope: f"SELECT {scope} AS scope, \"Response\", {col} AS pred FROM oof3"
_REPORT = lambda source: f"""every AS ({source}), sc AS (SELECT scope, threshold, {counts_sql('pred >= threshold')} FROM (SELECT CAST(k AS DOUBLE) / 100 AS threshold FROM range(1, 100) r(k)), every GROUP BY scope, threshold),
  swept AS (SELECT *, {rates_sql()} FROM sc), best AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY mcc DESC, threshold) AS place FROM swept)"""  # noqa: E731


def _scored(spark, sf_dir, col):
    """Stored scores as a model's out-of-fold scores, in five folds."""
    return X.oof3(spark, sf_dir).select("Id", "Response", F.col(col).alias("oof_pred"), F.expr("cast(Id % 5 as int)").alias("cv_fold"))


@query("m3_scored_report", f"""{O3}, {_REPORT(_SCORED('p1', "'fold ' || CAST(" + '"Id" % 5' + " AS VARCHAR)") + " UNION ALL " + _SCORED('p1', "'overall'"))} SELECT scope, tp + fp + fn + tn AS rows, threshold, round(mcc, 9) AS mcc FROM best WHERE place = 1""")
def m3_scored_report(spark, sf_dir):
    """The report of folds, of scores that are given."""
    return model.fold_report(_scored(spark, sf_dir, "p1")).withColumn("mcc", F.round("mcc", 9))


@query("m3_summary", f"""{O3}, {_REPORT(_SCORED('p1', "'first'") + " UNION ALL " + _SCORED('p3', "'second'"))} SELECT scope AS model, tp + fp + fn + tn AS rows, 5::BIGINT AS folds, threshold, round(mcc, 9) AS mcc FROM best WHERE place = 1""")
def m3_summary(spark, sf_dir):
    """The training summary: a row a model, the last report of each."""
    path = _scratch(spark, "training")
    for col, name in (("p2", "first"), ("p3", "second"), ("p1", "first")):
        out = model.record(_scored(spark, sf_dir, col), name, path)
    return out.drop("by_fold").withColumn("mcc", F.round("mcc", 9))


@query("a23_importance")
def a23(spark, sf_dir):
    return model.importance(spark, model.train_oof(_small(spark, sf_dir), model.BASELINE)[1])


META_SQL = f"""{O3}, m AS (SELECT *, (p1 + p2 + p3) / 3 AS mean_prediction FROM oof3), meta AS (SELECT *, sqrt(((p1 - mean_prediction) * (p1 - mean_prediction) + (p2 - mean_prediction) * (p2 - mean_prediction) + (p3 - mean_prediction) * (p3 - mean_prediction)) / 3) AS std_prediction,
  greatest(p1, p2, p3) AS max_prediction, CAST(p1 >= 0.5 AS INTEGER) + CAST(p2 >= 0.5 AS INTEGER) + CAST(p3 >= 0.5 AS INTEGER) AS agreement_count FROM m)"""


@query("m5_meta", f"{META_SQL} SELECT \"Id\", {R6(['mean_prediction', 'std_prediction', 'max_prediction'])}, agreement_count FROM meta")
def m5(spark, sf_dir):
    m = model.meta_features(X.oof3(spark, sf_dir), ["p1", "p2", "p3"])
    return m.select("Id", *[F.round(c, 6).alias(c) for c in ("mean_prediction", "std_prediction", "max_prediction")], "agreement_count")


@query("m6_stacked")
def m6(spark, sf_dir):
    """Three base models, on the baseline and on datasets G and H, and one on their out-of-fold scores; five folds each."""
    base = _small(spark, sf_dir, once=False)
    kinds = {"baseline": (lambda d: d, model.BASELINE), "dataset_g": (datasets.dataset_g, model.DATASET_G), "dataset_h": (datasets.dataset_h, model.DATASET_H)}
    oof = lambda kind: stored(model.train_oof(kind[0](base), kind[1])[0], "oof")
    # side by side, as jobs of one leave cores to those of others
    with ThreadPool(len(kinds)) as pool:
        bases = dict(zip(kinds, pool.map(inheritable_thread_target(spark)(oof), kinds.values()), strict=True))
    meta = model.stack(bases, base.select("Id", "chunk_id", "cv_fold"))
    return model.train_oof(meta, model.META)[0]


@query("m7_ensemble", f'{O3} SELECT "Id", round(((p1 + p2) / 2 + p3) / 2, 6) AS proba FROM oof3')
def m7(spark, sf_dir):
    return X.oof3(spark, sf_dir).select("Id", F.round(model.ensemble([[F.col("p1"), F.col("p2")], [F.col("p3")]]), 6).alias("proba"))


def _prepared(spark, sf_dir):
    """Parts, the state fitted on them (saved and loaded again), their features as prepare() gives them, with label and
    fold, and the names. Parts and features are made once, and stored by fold."""
    p, path = parts(spark, sf_dir), _scratch(spark, "prediction")
    made = state.raw(p, STATIONS)
    p = made.rows.select(*p.columns)
    fit, known = state.fit_known(p, stations=STATIONS, made=made)
    fit.save(f"{path}/state")
    fitted = state.State.load(spark, f"{path}/state")
    prepared = state.prepare(p.drop("Response"), fitted, p, stations=STATIONS, made=known, carry=("Response",), folds=F.pmod(F.xxhash64("Id"), F.lit(5)))
    return p, path, fitted, prepared, [n for n, kind, _ in fitted.columns() if kind != "string"]


@query("m8_predictions")
def m8(spark, sf_dir):
    """Raw rows to labels: state and five models are fitted, saved and loaded again."""
    p, path, fitted, prepared, names = _prepared(spark, sf_dir)
    model.train_oof(prepared[0], names)[1].save(spark, f"{path}/models")
    return predict.predict(p.drop("Response"), fitted, model.Trained.load(spark, f"{path}/models"), p, stations=STATIONS, prepared=prepared)[0]


@query("m9_trained")
def m9_trained(spark, sf_dir):
    """Raw rows to labels in two stages, both trained: the second on runs of duplicates, from the first's out-of-fold
    scores."""
    p, _, fitted, prepared, names = _prepared(spark, sf_dir)
    oof, first = model.train_oof(prepared[0], names)
    _, second = predict.train_second(prepared[0], stored(oof, "oof"))
    return predict.predict_two_stage(p.drop("Response"), fitted, first, second, p, stations=STATIONS, prepared=prepared)[0]


@query("m9_two_stage", f'{R} SELECT "Id", CASE WHEN run_size > 1 THEN score * score ELSE score END AS final_predicted_proba, CAST(CASE WHEN run_size > 1 THEN score * score ELSE score END >= 0.5 AS INTEGER) AS predicted_label, CAST(run_size > 1 AS INTEGER) AS is_duplicate_row FROM runs')
def m9(spark, sf_dir):
    d = run_rows(spark, sf_dir).withColumn("second", F.col("score") * F.col("score"))
    return model.route(d, "score", "second").select("Id", "final_predicted_proba", "predicted_label", "is_duplicate_row")


#: Stations of the test table in the blocks that name some.
STATIONS = state.Stations(("L0_S1", "L1_S2"), ("L0_S1", "L2_S3"), ("L0_S1",))
_SQ = f"signed AS (SELECT \"Id\", CASE WHEN s = '' THEN 'no_stations' ELSE s END AS path_signature FROM (SELECT \"Id\", concat_ws('|', {', '.join(f"""CASE WHEN coalesce("{s}_F1", "{s}_F2") IS NOT NULL THEN '{s}' END""" for s in CATALOG.stations)}) AS s FROM parts))"
_MED = lambda c: f"(SELECT coalesce(median({c}), 0) FROM starts0)"


@query("m10_fit_transform", f"""WITH {X.PARTS}, {_SQ}, starts0 AS (SELECT "Id", "Response", least({D_COLS}) AS st, greatest({D_COLS}) AS et, greatest({D_COLS}) - least({D_COLS}) AS du FROM parts),
  starts AS (SELECT "Id", "Response", coalesce(st, {_MED("st")}) AS start_time, coalesce(et, {_MED("et")}) AS end_time, coalesce(du, {_MED("du")}) AS duration FROM starts0),
  g AS (SELECT avg("Response") AS g FROM parts), pr AS (SELECT path_signature, count(*) AS n, (sum("Response") + 10 * g) / (count(*) + 10) AS r FROM signed JOIN parts p ON signed."Id" = p."Id", g GROUP BY path_signature, g),
  enc AS (SELECT "L0_S1_C1" AS v, avg("Response") AS r FROM parts WHERE "L0_S1_C1" IS NOT NULL GROUP BY 1),
  f AS (SELECT DISTINCT et AS ft FROM starts0 WHERE "Response" = 1 AND et IS NOT NULL), f0 AS (SELECT DISTINCT end_time AS ft FROM starts WHERE "Response" = 1), same AS (SELECT start_time, count(*) - 1 AS c FROM starts GROUP BY 1),
  m1 AS (SELECT coalesce(median(s.end_time - f0.ft), 0) AS m FROM starts s ASOF JOIN f0 ON s.end_time > f0.ft), r AS (SELECT "Id", row_number() OVER (ORDER BY "Id") AS r, count(*) OVER () AS n FROM parts)
  SELECT s."Id", round(s.start_time, 6) AS start_time, round(end_time, 6) AS end_time, round(duration, 6) AS duration, pr.path_signature, CAST(pr.n AS BIGINT) AS path_count, round(pr.r, 6) AS path_failure_rate, round(coalesce(enc.r, g), 6) AS "L0_S1_C1_target_enc",
    round(coalesce(s.end_time - f.ft, m1.m), 6) AS since_last_1, CAST(same.c AS INTEGER) AS records_same, CAST(least(r.r, 25) AS BIGINT) AS records_before_25, CAST(least(r.n - r.r + 1, 240) AS BIGINT) AS records_after_240
  FROM starts s JOIN signed q ON s."Id" = q."Id" JOIN pr ON q.path_signature = pr.path_signature JOIN parts p ON p."Id" = s."Id" LEFT JOIN enc ON p."L0_S1_C1" = enc.v ASOF LEFT JOIN f ON s.end_time > f.ft JOIN same ON s.start_time = same.start_time JOIN r ON r."Id" = s."Id", g, m1""")
def m10(spark, sf_dir):
    """Some of the columns that the fitted state gives the rows it was fitted on, looking back on them."""
    p, path = parts(spark, sf_dir), _scratch(spark, "state")
    made = state.raw(p, STATIONS)
    p = made.rows.select(*p.columns)
    fit, known = state.fit_known(p, stations=STATIONS, made=made)
    fit.save(path)
    d = state.transform(p.drop("Response"), state.State.load(spark, path), p, stations=STATIONS, made=known)[0]
    rounded = ["start_time", "end_time", "duration", "path_failure_rate", "L0_S1_C1_target_enc", "since_last_1"]
    return d.select("Id", "path_signature", "path_count", "records_same", F.col("records_before_25").cast("bigint").alias("records_before_25"), F.col("records_after_240").cast("bigint").alias("records_after_240"), *[F.round(c, 6).alias(c) for c in rounded])


@query("d1_stable_split", f"""{S}, r AS (SELECT "Id", row_number() OVER (ORDER BY md5("Id" || ':42'), "Id") - 1 AS i, count(*) OVER () AS n FROM scores) SELECT "Id", i < floor(n * 0.7::DOUBLE) AS is_reference FROM r""")
def d1(spark, sf_dir):
    return drift.stable_split(X.scores(spark, sf_dir)).select("Id", "is_reference")


def _pair(spark, sf_dir):
    s = X.scores(spark, sf_dir).withColumn("Id2", F.col("Id").cast("double"))
    return s.where("Id % 10 < 7"), s.where("Id % 10 >= 7").withColumn("pred", F.col("pred") + 0.2)


PAIR = f"""{S}, ref AS (SELECT *, CAST("Id" AS DOUBLE) AS "Id2" FROM scores WHERE "Id" % 10 < 7), cur AS (SELECT "Id", "Response", pred + 0.2::DOUBLE AS pred, CAST("Id" AS DOUBLE) AS "Id2" FROM scores WHERE "Id" % 10 >= 7)"""


def _fractions(col: str, out: str) -> str:
    return f"""{out}_u AS (SELECT x, sum(a) AS a, sum(b) AS b FROM (SELECT {col} AS x, 1 AS a, 0 AS b FROM ref UNION ALL SELECT {col}, 0, 1 FROM cur) GROUP BY x),
  {out} AS (SELECT x, sum(a) OVER (ORDER BY x) / (SELECT count(*) FROM ref)::DOUBLE AS f, sum(b) OVER (ORDER BY x) / (SELECT count(*) FROM cur)::DOUBLE AS g, lead(x) OVER (ORDER BY x) AS nx FROM {out}_u)"""


def _w1(col: str, out: str) -> str:
    return f"SELECT '{col}' AS \"column\", (SELECT sum(abs(f - g) * (nx - x)) FROM {out}) / (SELECT greatest(stddev_pop(\"{col}\"), 0.001) FROM ref) AS drift_score"


W1 = f"""{PAIR}, {_fractions('pred', 'fp')}, {_fractions('"Id2"', 'fi')}, w1 AS ({_w1('pred', 'fp')} UNION ALL {_w1('Id2', 'fi')}), ruled AS (SELECT *, 0.1 AS threshold, drift_score > 0.1 AS drift_detected FROM w1)"""


@query("d2_wasserstein", f'{W1} SELECT "column", round(drift_score, 6) AS drift_score FROM w1')
def d2(spark, sf_dir):
    return drift.wasserstein(*_pair(spark, sf_dir), ["pred", "Id2"]).select("column", F.round("drift_score", 6).alias("drift_score"))


_LAM = "sqrt(n::DOUBLE * m / (n + m)) * s"


def _ks(col: str, out: str) -> str:
    return f"""ks_{out} AS (SELECT '{col}' AS "column", max(abs(f - g)) AS s, (SELECT count(*) FROM ref) AS n, (SELECT count(*) FROM cur) AS m FROM {out})"""


def _p_value(source: str) -> str:
    return f"""SELECT "column", s, CASE WHEN {_LAM} < 0.2 THEN 1.0 ELSE least(greatest((SELECT sum(CASE WHEN k % 2 = 1 THEN 2.0 ELSE -2.0 END * exp(-2.0 * k * k * pow({_LAM}, 2))) FROM range(1, 101) t(k)), 0.0), 1.0) END AS p FROM {source}"""


@query("d3_drift_rule", f"""{W1}, js AS (SELECT sqrt(greatest(sum(CASE WHEN p > 0 THEN p * ln(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * ln(q / ((p + q) / 2)) ELSE 0 END) / 2, 0)) AS d
    FROM (SELECT sum(a)::DOUBLE / (SELECT count(*) FROM ref) AS p, sum(b)::DOUBLE / (SELECT count(*) FROM cur) AS q FROM (SELECT "Response" AS v, 1 AS a, 0 AS b FROM ref UNION ALL SELECT "Response", 0, 1 FROM cur) GROUP BY v)),
  {_ks('pred', 'fp')}, {_ks('Id2', 'fi')}, ks AS ({_p_value('(SELECT * FROM ks_fp UNION ALL SELECT * FROM ks_fi)')}), size AS (SELECT count(*) > 1000 AS large FROM ref)
  SELECT "column", CASE WHEN large THEN 'wasserstein' ELSE 'kolmogorov_smirnov' END AS test, round(CASE WHEN large THEN w1.drift_score ELSE ks.p END, 6) AS drift_score, CASE WHEN large THEN 0.1::DOUBLE ELSE 0.05::DOUBLE END AS threshold,
    CASE WHEN large THEN w1.drift_score > 0.1 ELSE ks.p < 0.05 END AS drift_detected FROM w1 JOIN ks USING ("column"), size
  UNION ALL SELECT 'Response', 'jensen_shannon', round(d, 6), 0.1::DOUBLE, d > 0.1 FROM js""")
def d3(spark, sf_dir):
    return drift.detect(*_pair(spark, sf_dir), ["pred", "Id2"], ["Response"]).withColumn("drift_score", F.round("drift_score", 6))


@query("d4_drift_summary", f"""{W1} SELECT count(*) FILTER (drift_detected) AS drifted_columns_count, count(*) AS number_of_columns, count(*) FILTER (drift_detected) / count(*)::DOUBLE AS drift_share,
  bool_or(drift_detected) FILTER ("column" = 'pred') AS prediction_drift, round(max(drift_score) FILTER ("column" = 'pred'), 6) AS prediction_score, coalesce(string_agg("column", ',' ORDER BY drift_score DESC) FILTER (drift_detected), '') AS drifted_columns FROM ruled""")
def d4(spark, sf_dir):
    out = drift.summary(drift.rule(drift.wasserstein(*_pair(spark, sf_dir), ["pred", "Id2"])))
    return out.withColumn("prediction_score", F.round("prediction_score", 6))


@query("d5_jensen_shannon", f"""{PAIR}, u AS (SELECT "Response" AS v, sum(a)::DOUBLE / (SELECT count(*) FROM ref) AS p, sum(b)::DOUBLE / (SELECT count(*) FROM cur) AS q FROM (SELECT "Response", 1 AS a, 0 AS b FROM ref UNION ALL SELECT "Response", 0, 1 FROM cur) GROUP BY 1)
  SELECT 'Response' AS "column", round(sqrt(greatest(sum(CASE WHEN p > 0 THEN p * ln(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * ln(q / ((p + q) / 2)) ELSE 0 END) / 2, 0)), 6) AS drift_score FROM u""")
def d5(spark, sf_dir):
    return drift.jensen_shannon(*_pair(spark, sf_dir), "Response").withColumn("drift_score", F.round("drift_score", 6))


@query("d6_kolmogorov_smirnov", f"""{PAIR}, {_fractions('pred', 'fp')}, {_fractions('"Id2"', 'fi')}, {_ks('pred', 'fp')}, {_ks('Id2', 'fi')} SELECT "column", round(s, 9) AS statistic, round(p, 9) AS p_value FROM ({_p_value('(SELECT * FROM ks_fp UNION ALL SELECT * FROM ks_fi)')})""")
def d6(spark, sf_dir):
    out = drift.kolmogorov_smirnov(*_pair(spark, sf_dir), ["pred", "Id2"])
    return out.select("column", F.round("statistic", 9).alias("statistic"), F.round("p_value", 9).alias("p_value"))


_CHI = """greatest(0.0, least(1.0, CASE WHEN x <= 0 THEN 1.0 WHEN x > 600 THEN 0.0 ELSE 1 - exp(-x / 2 + k / 2 * ln(x / 2) - lgamma(k / 2 + 1)) * (SELECT sum(exp(n * ln(x / 2) + lgamma(k / 2 + 1) - lgamma(k / 2 + 1 + n))) FROM range(0, 900) r(n)) END))"""


@query("d7_account_drift", f"""WITH ref AS (SELECT s_nationkey AS nation, s_acctbal > 0 AS credit, s_nationkey % 4 AS part FROM supplier), cur AS (SELECT c_nationkey AS nation, c_acctbal > 0 AS credit, c_nationkey % 4 AS part FROM customer),
  u AS (SELECT c AS "column", v, sum(a)::DOUBLE AS a, sum(b)::DOUBLE AS b FROM (SELECT 'nation' AS c, CAST(nation AS VARCHAR) AS v, 1 AS a, 0 AS b FROM ref UNION ALL SELECT 'nation', CAST(nation AS VARCHAR), 0, 1 FROM cur UNION ALL SELECT 'credit', CAST(credit AS VARCHAR), 1, 0 FROM ref
    UNION ALL SELECT 'credit', CAST(credit AS VARCHAR), 0, 1 FROM cur UNION ALL SELECT 'part', CAST(part AS VARCHAR), 1, 0 FROM ref UNION ALL SELECT 'part', CAST(part AS VARCHAR), 0, 1 FROM cur) GROUP BY 1, 2),
  t AS (SELECT *, sum(a) OVER (PARTITION BY "column") AS n, sum(b) OVER (PARTITION BY "column") AS m, count(*) OVER (PARTITION BY "column") AS kinds FROM u), q AS (SELECT *, a * m / n AS e, (a + b) / (n + m) AS s, a / n AS f, b / m AS g FROM t),
  w AS (SELECT "column", any_value(kinds) AS kinds, sum(CASE WHEN a > 0 THEN (b - e) * (b - e) / e WHEN b > 0 THEN 1e9 ELSE 0 END) AS chi, max(CASE WHEN s < 1 THEN (f - g) * (f - g) / (s * (1 - s) * (1 / n + 1 / m)) ELSE 0 END) AS z,
    sqrt(greatest(sum(CASE WHEN f > 0 THEN f * ln(f / ((f + g) / 2)) ELSE 0 END + CASE WHEN g > 0 THEN g * ln(g / ((f + g) / 2)) ELSE 0 END) / 2, 0)) AS js FROM q GROUP BY 1),
  x AS (SELECT *, CASE WHEN kinds <= 2 THEN z ELSE chi END AS x, CASE WHEN kinds <= 2 THEN 1.0::DOUBLE ELSE (kinds - 1)::DOUBLE END AS k, (SELECT count(*) > 1000 FROM ref) AS large FROM w), p AS (SELECT *, CASE WHEN large THEN js ELSE {_CHI} END AS score FROM x)
  SELECT "column", CASE WHEN large THEN 'jensen_shannon' WHEN kinds <= 2 THEN 'z_test' ELSE 'chi_square' END AS test, round(score, 6) AS drift_score, CASE WHEN large THEN 0.1::DOUBLE ELSE 0.05::DOUBLE END AS threshold, CASE WHEN large THEN score > 0.1 ELSE score < 0.05 END AS drift_detected FROM p""")
def d7(spark, sf_dir):
    """Accounts of suppliers against those of customers: categories with many, two and few values (the last are numbers)."""
    rows = lambda t, c: X.load(spark, sf_dir, t).select(F.col(f"{c}_nationkey").alias("nation"), (F.col(f"{c}_acctbal") > 0).alias("credit"), (F.col(f"{c}_nationkey") % 4).alias("part"))
    return drift.detect(rows("supplier", "s"), rows("customer", "c"), ["part"], ["nation", "credit"]).withColumn("drift_score", F.round("drift_score", 6))


@query("q1_no_nulls", f"""{S}, x AS (SELECT count(*) FILTER ("Id" IS NULL OR "Response" IS NULL OR pred IS NULL) AS b FROM scores) SELECT 'scores' AS module, 'no_nulls' AS "check", b = 0 AS passed FROM x""")
def q1(spark, sf_dir):
    return quality.no_nulls(X.scores(spark, sf_dir), "scores")


@query("q2_checks", f"""{S} SELECT 'scores' AS module, 'pred_in_range' AS "check", bool_and(pred BETWEEN 0 AND 1) AS passed FROM scores UNION ALL SELECT 'scores', 'Response_in_range', bool_and("Response" BETWEEN 0 AND 1) FROM scores
  UNION ALL SELECT 'scores', 'absent_in_range', false UNION ALL SELECT 'scores', 'not_empty', count(*) > 0 FROM scores""")
def q2(spark, sf_dir):
    s = X.scores(spark, sf_dir)
    return quality.in_range(s, "scores", {"pred": (0, 1), "Response": (0, 1), "absent": (0, 1)}).unionByName(quality.not_empty(s, "scores"))


_CROSS = f"""{B}, {TABLE}, a AS (SELECT recall FROM decisions d ORDER BY {_COST} LIMIT 1) SELECT 'cross' AS module, 'replay_recall' AS "check", (SELECT avg(recall) FROM q) >= a.recall - 0.25 AS passed FROM a"""


@query("q3_cross_check", _CROSS)
def q3(spark, sf_dir):
    return quality.recall_consistent(metrics.operating_points(table(spark, sf_dir)), replay.replay_summary(batch_rows(spark, sf_dir)))


@query("q4_overall", f"""{S} SELECT bool_and(pred BETWEEN 0 AND 1) AND count(*) > 0 AND count(*) FILTER (pred IS NULL) = 0 AS passed, 3::BIGINT AS checks, CASE WHEN bool_and(pred BETWEEN 0 AND 1) THEN 0 ELSE 1 END::BIGINT AS failed FROM scores""")
def q4(spark, sf_dir):
    s = X.scores(spark, sf_dir)
    checks = quality.in_range(s, "scores", {"pred": (0, 1)}).unionByName(quality.not_empty(s, "scores")).unionByName(quality.no_nulls(s, "scores"))
    return quality.overall(checks)

