"""Queries of joins, aggregations and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from millwatch.operators import decide, encode, folds, joins, metrics, ordering, paths
from millwatch.plans import fixtures as X
from millwatch.plans.q_rows import SIGNED, START, TOKENS, WP, parts, signed, started
from millwatch.plans.q_windows import BATCHES, HYBRID, S, T
from millwatch.plans.registry import SQL, query
from millwatch.sources.io import stored
from millwatch.streaming import sliding

P = f"{WP}, {SIGNED}"
O3 = f"WITH {X.OOF3}"


@query("j1_one_to_one", f'{WP}, {SIGNED}, {START} SELECT a."Id", path_signature, start_time FROM signed a JOIN starts b ON a."Id" = b."Id"')
def j1(spark, sf_dir):
    return joins.one_to_one(signed(spark, sf_dir).select("Id", "path_signature"), started(spark, sf_dir).select("Id", "start_time"))


@query("j2_left_filled", f'{O3} SELECT s."Id", s."Response", coalesce(a.pred, 0) AS pred FROM scores s LEFT JOIN scores_alt a ON s."Id" = a."Id"')
def j2(spark, sf_dir):
    return joins.left_filled(X.scores(spark, sf_dir).select("Id", "Response"), X.scores_alt(spark, sf_dir), "Id", {"pred": 0.0})


@query("j3_lookup", f"""{P}, r AS (SELECT path_signature, avg("Response") AS rate, count(*) AS n FROM signed GROUP BY 1 HAVING count(*) >= 50), g AS (SELECT avg("Response") AS g FROM signed)
  SELECT "Id", round(coalesce(rate, g), 6) AS rate FROM signed s LEFT JOIN r ON s.path_signature = r.path_signature, g""")
def j3(spark, sf_dir):
    d = signed(spark, sf_dir)
    table = d.groupBy("path_signature").agg(F.avg("Response").alias("r"), F.count("*").alias("n")).where("n >= 50")
    return joins.lookup(d, table, "path_signature", "r", d.agg(F.avg("Response").alias("g")), "rate").select("Id", F.round("rate", 6).alias("rate"))


_FAIL = """f AS (SELECT t AS ft, max("Id") AS fid FROM ticks WHERE "Response" = 1 GROUP BY t)"""


@query("j4_as_of", f'{T}, {_FAIL} SELECT "Id", fid FROM ticks ASOF LEFT JOIN f ON ticks.t >= f.ft')
def j4(spark, sf_dir):
    d = X.ticks(spark, sf_dir)
    r = d.where("Response = 1").select(F.col("t").alias("ft"), F.col("Id").alias("fid"))
    return ordering.as_of(d.select("Id", "t"), r, "t", "ft", "fid", ["fid"]).select("Id", "fid")


@query("j5_as_of_strict", f'{T}, {_FAIL} SELECT "Id", fid FROM ticks ASOF LEFT JOIN f ON ticks.t > f.ft')
def j5(spark, sf_dir):
    d = X.ticks(spark, sf_dir)
    r = d.where("Response = 1").select(F.col("t").alias("ft"), F.col("Id").alias("fid"))
    return ordering.as_of(d.select("Id", "t"), r, "t", "ft", "fid", ["fid"], strict=True).select("Id", "fid")


@query("a1_frequency", f'{P} SELECT "Id", count(*) OVER (PARTITION BY path_signature) AS path_count FROM signed')
def a1(spark, sf_dir):
    return paths.frequency(signed(spark, sf_dir), "path_signature", "path_count").select("Id", "path_count")


_CATS = ["L0_S1_C1", "L1_S2_C1", "L2_S3_C1"]


def _enc_sql() -> str:
    ctes = ", ".join(f'e{k} AS (SELECT "{c}" AS v, avg("Response") AS r FROM parts WHERE "{c}" IS NOT NULL GROUP BY 1)' for k, c in enumerate(_CATS))
    cols = ", ".join(f'round(coalesce(e{k}.r, g), 6) AS "{c}_target_enc"' for k, c in enumerate(_CATS))
    on = " ".join(f'LEFT JOIN e{k} ON p."{c}" = e{k}.v' for k, c in enumerate(_CATS))
    return f'{WP}, g AS (SELECT avg("Response") AS g FROM parts), {ctes} SELECT "Id", {cols} FROM parts p {on}, g'


@query("a2_target_encoding", _enc_sql())
def a2(spark, sf_dir):
    d = stored(parts(spark, sf_dir), "parts")
    out = encode.apply_encoding(d, stored(encode.target_encoding(d, _CATS), "encodings"), _CATS, d.agg(F.avg("Response").alias("g")))
    return out.select("Id", *[F.round(f"{c}_target_enc", 6).alias(f"{c}_target_enc") for c in _CATS])


@query("a3_smoothed_rate", f"""{P}, g AS (SELECT avg("Response") AS g FROM signed) SELECT path_signature, count(*) AS n, round((sum("Response") + 10 * any_value(g)) / (count(*) + 10), 6) AS rate FROM signed, g GROUP BY path_signature""")
def a3(spark, sf_dir):
    return paths.smoothed_rate(signed(spark, sf_dir), "path_signature").select("path_signature", "n", F.round("rate", 6).alias("rate"))


# folds of the ticks by time chunk, and of the parts by signature
CHUNKED = f"""{X.TICKS}, chunked AS (SELECT *, CAST((row_number() OVER (ORDER BY t, "Id") - 1) // 200 AS INTEGER) AS chunk_id FROM ticks)"""


def folds_sql(source: str, group: str, out: str = "folds") -> str:
    return f"""{out}_g AS (SELECT {group} AS grp, sum("Response") AS p, count(*) AS n FROM {source} GROUP BY 1),
  {out}_r AS (SELECT grp, (row_number() OVER (ORDER BY p DESC, n DESC, md5(CAST(grp AS VARCHAR) || ':42'), grp) - 1) % 10 AS r FROM {out}_g),
  {out} AS (SELECT grp, CAST(CASE WHEN r < 5 THEN r ELSE 9 - r END AS INTEGER) AS cv_fold FROM {out}_r)"""


def chunked(spark, sf_dir):
    return ordering.chunk_ids(X.ticks(spark, sf_dir), "t", "Id", 200)


def folded_parts(spark, sf_dir):
    """Parts with signature and folds by chunks of 300 in Id order."""
    d = ordering.chunk_ids(signed(spark, sf_dir), "Id", "Id", 300)
    return folds.assign_folds(d, folds.group_folds(d, "chunk_id"), "chunk_id", check=False)


FOLDED = f"""{X.PARTS}, {SIGNED}, cparts AS (SELECT *, CAST((row_number() OVER (ORDER BY "Id") - 1) // 300 AS INTEGER) AS chunk_id FROM signed), {folds_sql("cparts", "chunk_id")},
  fparts AS (SELECT c.*, f.cv_fold FROM cparts c JOIN folds f ON c.chunk_id = f.grp)"""


def oof_sql(key: str, source: str = "fparts", out: str = "oof") -> str:
    return f"""{out}_k AS (SELECT {key} AS k, cv_fold AS f, sum("Response") AS s, count(*) AS n FROM {source} GROUP BY 1, 2),
  {out} AS (SELECT k, f, (sum(s) OVER (PARTITION BY k) - s) / nullif(sum(n) OVER (PARTITION BY k) - n, 0)::DOUBLE AS r FROM {out}_k)"""


G = 'g AS (SELECT avg("Response") AS g FROM fparts)'


@query("a4_oof_rate", f"""WITH {FOLDED}, {oof_sql("path_signature")}, {oof_sql("chunk_id", out="oofc")}, {G}
  SELECT "Id", round(coalesce(oof.r, g), 6) AS signature_rate, round(coalesce(oofc.r, g), 6) AS chunk_rate FROM fparts p LEFT JOIN oof ON p.path_signature = oof.k AND p.cv_fold = oof.f LEFT JOIN oofc ON p.chunk_id = oofc.k AND p.cv_fold = oofc.f, g""")
def a4(spark, sf_dir):
    d = encode.oof_rate(folded_parts(spark, sf_dir), "path_signature", out="a")
    d = encode.oof_rate(d, "chunk_id", out="b")
    return d.select("Id", F.round("a", 6).alias("signature_rate"), F.round("b", 6).alias("chunk_rate"))


def tokens_sql(expr: str, out: str) -> str:
    """(token, f, r): out-of-fold rates of the tokens that `expr` makes of k."""
    return f"""{out}_s AS (SELECT path_signature, cv_fold AS f, sum("Response") AS s, count(*) AS n, {TOKENS} AS k FROM fparts GROUP BY path_signature, cv_fold),
  {out}_e AS (SELECT f, s, n, unnest({expr}) AS token FROM {out}_s), {out}_t AS (SELECT token, f, sum(s) AS s, sum(n) AS n FROM {out}_e GROUP BY 1, 2),
  {out}_a AS (SELECT token, sum(s) AS s, sum(n) AS n FROM {out}_t GROUP BY 1), {out}_f AS (SELECT DISTINCT cv_fold AS f FROM fparts),
  {out} AS (SELECT a.token, x.f, (a.s - coalesce(t.s, 0)) / nullif(a.n - coalesce(t.n, 0), 0)::DOUBLE AS r FROM {out}_a a CROSS JOIN {out}_f x LEFT JOIN {out}_t t ON a.token = t.token AND x.f = t.f)"""


TRANS = "list_transform(range(1, len(k)), lambda i: k[i] || '>' || k[i + 1])"


@query("a5_oof_token_rates", f"""WITH {FOLDED}, {tokens_sql("k", "st")}, {tokens_sql(TRANS, "tr")} SELECT token, f AS cv_fold, round(r, 6) AS rate FROM st UNION ALL SELECT token, f, round(r, 6) FROM tr""")
def a5(spark, sf_dir):
    d, t = folded_parts(spark, sf_dir), encode.tokens_of("path_signature")
    out = encode.oof_token_rates(d, "path_signature", t).unionByName(encode.oof_token_rates(d, "path_signature", paths.transitions(t)))
    return out.select("token", "cv_fold", F.round("rate", 6).alias("rate"))


A6 = f"""{tokens_sql(TRANS, "tr")}, {G}, sf AS (SELECT DISTINCT path_signature, cv_fold, {TOKENS} AS k FROM fparts), se AS (SELECT path_signature, cv_fold, unnest({TRANS}) AS token FROM sf),
  sa AS (SELECT path_signature, cv_fold, avg(coalesce(r, g)) AS m, max(coalesce(r, g)) AS x, stddev_pop(coalesce(r, g)) AS d FROM se LEFT JOIN tr ON se.token = tr.token AND se.cv_fold = tr.f, g GROUP BY 1, 2)"""


@query("a6_signature_token_stats", f"""WITH {FOLDED}, {A6} SELECT sf.path_signature, sf.cv_fold, round(coalesce(m, g), 6) AS rate_mean, round(coalesce(x, g), 6) AS rate_max, round(coalesce(d, 0), 6) AS rate_std
  FROM sf LEFT JOIN sa ON sf.path_signature = sa.path_signature AND sf.cv_fold = sa.cv_fold, g""")
def a6(spark, sf_dir):
    d, t = folded_parts(spark, sf_dir), paths.transitions(encode.tokens_of("path_signature"))
    out = encode.signature_token_stats(d, "path_signature", t, encode.oof_token_rates(d, "path_signature", t), ("rate_mean", "rate_max", "rate_std"))
    return out.select("path_signature", "cv_fold", *[F.round(c, 6).alias(c) for c in ("rate_mean", "rate_max", "rate_std")])


PAIRS = "flatten(list_transform(range(1, len(k)), lambda i: list_transform(range(i + 1, len(k) + 1), lambda j: k[i] || '&' || k[j])))"
A7 = f"""pd AS (SELECT path_signature, count(*) AS n, {TOKENS} AS k FROM signed GROUP BY path_signature), pe AS (SELECT path_signature, n, unnest({PAIRS}) AS pair FROM pd), pw AS (SELECT pair, sum(n) AS w FROM pe GROUP BY 1),
  ps AS (SELECT path_signature, avg(w) AS a, max(w) AS b, stddev_pop(w) AS c FROM pe JOIN pw USING (pair) GROUP BY 1)"""


@query("a7_pair_cooccurrence", f"""{P}, {A7} SELECT pd.path_signature, round(coalesce(a, 0), 6) AS pair_cooccur_mean, CAST(coalesce(b, 0) AS DOUBLE) AS pair_cooccur_max, round(coalesce(c, 0), 6) AS pair_cooccur_std FROM pd LEFT JOIN ps USING (path_signature)""")
def a7(spark, sf_dir):
    out = paths.pair_cooccurrence(signed(spark, sf_dir))
    return out.select("path_signature", F.round("pair_cooccur_mean", 6).alias("pair_cooccur_mean"), "pair_cooccur_max", F.round("pair_cooccur_std", 6).alias("pair_cooccur_std"))


@query("a8_global_mean", f'{S} SELECT round(avg("Response"), 9) AS mean FROM scores')
def a8(spark, sf_dir):
    return X.scores(spark, sf_dir).agg(F.round(F.avg("Response"), 9).alias("mean"))


def rates_sql(total: str = "(tp + fp + fn + tn)") -> str:
    return f"""coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) AS precision, coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) AS recall, 100 * coalesce((tp + fp) / nullif({total}, 0)::DOUBLE, 0) AS flagged_pct,
  coalesce((tp::DOUBLE * tn - fp::DOUBLE * fn) / nullif(sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0) AS mcc"""


def counts_sql(flag: str) -> str:
    return f"""count(*) FILTER ("Response" = 1 AND {flag}) AS tp, count(*) FILTER ("Response" = 0 AND {flag}) AS fp, count(*) FILTER ("Response" = 1 AND NOT ({flag})) AS fn, count(*) FILTER ("Response" = 0 AND NOT ({flag})) AS tn"""


@query("a9_confusion", f"{S}, {HYBRID}, c AS (SELECT {counts_sql('auto_reject + manual_inspect > 0')} FROM hybrid), r AS (SELECT *, {rates_sql()} FROM c) SELECT tp, fp, fn, tn, round(precision, 9) AS precision, round(recall, 9) AS recall, round(flagged_pct, 9) AS flagged_pct FROM r")
def a9(spark, sf_dir):
    c = metrics.confusion(decide.hybrid(X.scores(spark, sf_dir)))
    return c.select("tp", "fp", "fn", "tn", *[F.round(x, 9).alias(x) for x in ("precision", "recall", "flagged_pct")])


@query("a10_mcc", f"{S}, c AS (SELECT {counts_sql('pred >= 0.6')} FROM scores), r AS (SELECT *, {rates_sql()} FROM c) SELECT round(mcc, 9) AS mcc FROM r")
def a10(spark, sf_dir):
    d = X.scores(spark, sf_dir).withColumn("decision", decide.over_threshold("pred", 0.6, single=False))
    return metrics.confusion(d).select(F.round("mcc", 9).alias("mcc"))


SWEEP = f"""grid AS (SELECT CAST(k AS DOUBLE) / 100 AS threshold FROM range(1, 100) r(k)), sc AS (SELECT threshold, {counts_sql('pred >= threshold')} FROM grid, scores GROUP BY threshold), sweep AS (SELECT *, {rates_sql()} FROM sc)"""
_R9 = lambda names: ", ".join(f"round({c}, 9) AS {c}" for c in names)


def sweep(spark, sf_dir):
    return metrics.threshold_sweep(X.scores(spark, sf_dir))


def r9(df, plain, rounded):
    return df.select(*plain, *[F.round(c, 9).alias(c) for c in rounded])


@query("a11_threshold_sweep", f"{S}, {SWEEP} SELECT threshold, tp, fp, fn, tn, {_R9(['precision', 'recall', 'mcc'])}, round(flagged_pct, 9) AS positives_pct FROM sweep")
def a11(spark, sf_dir):
    return r9(sweep(spark, sf_dir), ["threshold", "tp", "fp", "fn", "tn"], ["precision", "recall", "mcc", "positives_pct"])


@query("a12_best_threshold", f"{S}, {SWEEP} SELECT threshold, round(mcc, 9) AS mcc FROM sweep ORDER BY sweep.mcc DESC, threshold LIMIT 1")
def a12(spark, sf_dir):
    return r9(metrics.best_threshold(sweep(spark, sf_dir)), ["threshold"], ["mcc"])


SQL["s6_csv_tables"] = SQL["a11_threshold_sweep"]
SQL["s10_summary"] = f"{S}, {SWEEP} SELECT 'first' AS model, threshold, round(mcc + 1, 9) AS mcc FROM sweep ORDER BY sweep.mcc DESC, threshold LIMIT 1"
BUDGET = f"""rk AS (SELECT *, row_number() OVER (ORDER BY pred DESC, "Id") AS r, count(*) OVER () AS n FROM scores), bk AS (SELECT CAST(b AS DOUBLE) AS inspection_budget_pct, CAST(ceil(n * (b / 100.0::DOUBLE)) AS BIGINT) AS selected_rows FROM range(1, 11) x(b), (SELECT count(*) AS n FROM scores)),
  bc AS (SELECT inspection_budget_pct, selected_rows, min(pred) FILTER (r = selected_rows) AS score_cutoff, {counts_sql('r <= selected_rows')} FROM bk, rk GROUP BY 1, 2), budget AS (SELECT *, {rates_sql()} FROM bc)"""


def budget(spark, sf_dir):
    return metrics.budget_curve(X.scores(spark, sf_dir))


@query("a13_budget_curve", f"{S}, {BUDGET} SELECT inspection_budget_pct, selected_rows, score_cutoff, tp, fp, fn, tn, {_R9(['precision', 'recall', 'mcc'])} FROM budget")
def a13(spark, sf_dir):
    return r9(budget(spark, sf_dir), ["inspection_budget_pct", "selected_rows", "score_cutoff", "tp", "fp", "fn", "tn"], ["precision", "recall", "mcc"])


@query("a14_scalars", f"""{WP}, {START} SELECT round(avg(duration), 6) AS mean, round(stddev_samp(duration), 6) AS std, round(quantile_cont(duration, 0.9), 6) AS p90, round(quantile_cont(duration, 0.1), 6) AS p10, median(start_time) AS median_start FROM starts""")
def a14(spark, sf_dir):
    s = started(spark, sf_dir)
    one = encode.scalars(s, "duration").crossJoin(encode.medians(s, ["start_time"]).select(F.col("median").alias("median_start")))
    return one.select(*[F.round(c, 6).alias(c) for c in ("mean", "std", "p90", "p10")], "median_start")


@query("a15_fixed_precision", f"""{S}, {SWEEP}, tg AS (SELECT CAST(k AS DOUBLE) / 100 AS target_precision FROM range(5, 55, 5) r(k)), j AS (SELECT target_precision, s.*, row_number() OVER (PARTITION BY target_precision ORDER BY recall DESC NULLS LAST, threshold) AS rn FROM tg LEFT JOIN sweep s ON s.precision >= target_precision)
  SELECT target_precision, threshold IS NOT NULL AS available, threshold, {_R9(['precision', 'recall', 'mcc'])} FROM j WHERE rn = 1""")
def a15(spark, sf_dir):
    return r9(metrics.fixed_precision(sweep(spark, sf_dir)), ["target_precision", "available", "threshold"], ["precision", "recall", "mcc"])


@query("a16_risk_groups", f"""{S}, z AS (SELECT quantile_cont(pred, 0.9) AS hi, quantile_cont(pred, 0.7) AS mid FROM scores), g AS (SELECT *, CASE WHEN pred >= hi THEN 'HIGH' WHEN pred >= mid THEN 'MEDIUM' ELSE 'LOW' END AS risk_group FROM scores, z)
  SELECT risk_group, count(*) AS parts, round(100 * avg("Response"), 6) AS failure_pct, round(avg(pred), 6) AS mean_score FROM g GROUP BY 1""")
def a16(spark, sf_dir):
    return metrics.risk_groups(X.scores(spark, sf_dir)).select("risk_group", "parts", F.round("failure_pct", 6).alias("failure_pct"), F.round("mean_score", 6).alias("mean_score"))


_TAIL = "tp + fp AS total_flagged_rows, tp AS failures_caught, fn AS failures_missed, 100.0 * fn + 5.0 * fp AS total_cost, (100.0 * fn + 5.0 * fp) / (tp + fp + fn + tn)::DOUBLE * 100000 AS cost_per_100k_rows"
_THR = lambda name, k: f"SELECT '{name}' AS source, 'threshold' AS mode, printf('thr=%.2f', threshold) AS configuration, CAST(NULL AS DOUBLE) AS inspection_budget_pct, threshold, recall, precision, mcc, tp, fp, fn, tn, {k} AS src_order, {_TAIL} FROM sweep"
TABLE = f"""{SWEEP}, {BUDGET}, decisions AS ({_THR('threshold_sweep', 0)} UNION ALL {_THR('model_sweep', 1)} UNION ALL
  SELECT 'budget_curve', 'budget', printf('budget=%d%%', CAST(inspection_budget_pct AS INTEGER)), inspection_budget_pct, score_cutoff, recall, precision, mcc, tp, fp, fn, tn, 2, {_TAIL} FROM budget)"""
_DCOLS = ["source", "mode", "configuration", "inspection_budget_pct", "threshold", "tp", "fp", "fn", "tn", "src_order", "total_flagged_rows", "failures_caught", "failures_missed"]
_DROUND = ["recall", "precision", "mcc", "total_cost", "cost_per_100k_rows"]
R6 = lambda names: ", ".join(f"round({c}, 6) AS {c}" for c in names)


def table(spark, sf_dir):
    s = sweep(spark, sf_dir)
    return metrics.decision_table({"threshold_sweep": s, "model_sweep": s}, budget(spark, sf_dir))


@query("a17_decision_table", f"{S}, {TABLE} SELECT {', '.join(_DCOLS)}, {R6(_DROUND)} FROM decisions")
def a17(spark, sf_dir):
    return table(spark, sf_dir).select(*_DCOLS, *[F.round(c, 6).alias(c) for c in _DROUND])


def _top(point: str, where: str, order: str) -> str:
    return f"(SELECT '{point}' AS point, source, configuration, threshold, {R6(['recall', 'precision', 'mcc', 'total_cost'])} FROM decisions d WHERE {where} ORDER BY {order} LIMIT 1)"


_COST, _RECALL = "d.total_cost, d.recall DESC, src_order, threshold", "d.recall DESC, d.total_cost, src_order, threshold"
_F1 = "2 * d.precision * d.recall / (d.precision + d.recall + 1e-12) DESC, d.mcc DESC, src_order, threshold"
POINTS = " UNION ALL ".join([_top("min_cost", "true", _COST), _top("best_f1", "true", _F1), *[_top(f"best_recall_at_{b}pct", f"inspection_budget_pct <= {b}", _RECALL) for b in (1, 5, 10)]])
_PCOLS = ["point", "source", "configuration", "threshold"]


@query("a18_operating_points", f"{S}, {TABLE} SELECT *, true AS available FROM ({POINTS})")
def a18(spark, sf_dir):
    return metrics.operating_points(table(spark, sf_dir)).select(*_PCOLS, *[F.round(c, 6).alias(c) for c in ("recall", "precision", "mcc", "total_cost")], "available")


@query("a20_segments", f"""{S} SELECT CASE WHEN pred >= 0.6 THEN 'TP' ELSE 'FN' END AS segment, count(*) AS parts, round(avg(pred), 6) AS mean_score FROM scores WHERE "Response" = 1 GROUP BY 1""")
def a20(spark, sf_dir):
    return metrics.segments(X.scores(spark, sf_dir), 0.6).select("segment", "parts", F.round("mean_score", 6).alias("mean_score"))


@query("a21_histogram", f"""{S}, e AS (SELECT min(pred) AS lo, max(pred) AS hi FROM scores) SELECT "Response", CAST(least(floor((pred - lo) * 100 / (hi - lo)), 99) AS INTEGER) AS bin, count(*) AS parts FROM scores, e GROUP BY 1, 2""")
def a21(spark, sf_dir):
    return metrics.histogram(X.scores(spark, sf_dir), 100, by=["Response"])


@query("a22_overview", f"""{S}, {TABLE}, b AS (SELECT threshold, mcc FROM sweep ORDER BY mcc DESC, threshold LIMIT 1), m AS (SELECT configuration, total_cost FROM decisions d ORDER BY {_COST} LIMIT 1)
  SELECT (SELECT count(*) FROM scores) AS rows, round((SELECT 100 * avg("Response") FROM scores), 6) AS failure_pct, b.threshold AS best_threshold, round(b.mcc, 9) AS best_mcc, m.configuration AS min_cost_configuration, m.total_cost AS min_cost FROM b, m""")
def a22(spark, sf_dir):
    s = X.scores(spark, sf_dir)
    b = metrics.best_threshold(sweep(spark, sf_dir)).select(F.col("threshold").alias("best_threshold"), F.round("mcc", 9).alias("best_mcc"))
    m = table(spark, sf_dir).orderBy("total_cost", F.desc("recall"), "src_order", "threshold").limit(1).select(F.col("configuration").alias("min_cost_configuration"), F.col("total_cost").alias("min_cost"))
    return s.agg(F.count("*").alias("rows"), F.round(100 * F.avg("Response"), 6).alias("failure_pct")).crossJoin(b).crossJoin(m)


@query("a24_best_source", f"""{O3}, u AS (SELECT "Id", "Response", p1 AS pred, 'first' AS source, 0 AS k FROM oof3 UNION ALL SELECT "Id", "Response", p2, 'second', 1 FROM oof3),
  c AS (SELECT source, k, {counts_sql('pred >= 0.74')} FROM u GROUP BY 1, 2), r AS (SELECT *, {rates_sql()} FROM c), b AS (SELECT source, mcc FROM r ORDER BY mcc DESC, k LIMIT 1)
  SELECT u."Id", u."Response", u.pred, u.source, round(b.mcc, 9) AS mcc FROM u JOIN b ON u.source = b.source""")
def a24(spark, sf_dir):
    o = X.oof3(spark, sf_dir)
    out = metrics.best_source({"first": o.withColumn("pred", F.col("p1")), "second": o.withColumn("pred", F.col("p2"))})
    return out.withColumn("mcc", F.round("mcc", 9))


_REPORT = ", ".join(f"round(avg({c}), 6) AS {c}_mean, round(stddev_samp({c}), 6) AS {c}_std" for c in sliding.SIGNALS)


@query("a19_policy_replay", f"""{O3}, {SWEEP}, policy AS (SELECT threshold FROM sweep ORDER BY mcc DESC, threshold LIMIT 1),
  u AS (SELECT "Id", "Response", p1 AS pred, 'first' AS source, 0 AS k FROM oof3 UNION ALL SELECT "Id", "Response", p2, 'second', 1 FROM oof3 UNION ALL SELECT "Id", "Response", p3, 'mean', 2 FROM oof3),
  uc AS (SELECT source, k, {counts_sql('pred >= 0.74')} FROM u GROUP BY 1, 2), ur AS (SELECT *, {rates_sql()} FROM uc), best AS (SELECT source, mcc FROM ur ORDER BY mcc DESC, k LIMIT 1),
  b AS (SELECT u.*, row_number() OVER (ORDER BY "Id") - 1 AS pos, (row_number() OVER (ORDER BY "Id") - 1) // 1000 AS batch FROM u JOIN best USING (source)), {BATCHES.replace('0.6', '(SELECT threshold FROM policy)')}
  SELECT any_value(best.source) AS source, round(any_value(best.mcc), 9) AS source_mcc, round(any_value(policy.threshold), 9) AS threshold_high, 5.0::DOUBLE AS inspection_budget_pct, 1000 AS batch_size, count(*) AS batches, {_REPORT} FROM q, best, policy""")
def a19_policy(spark, sf_dir):
    """Best threshold to a policy file, and from that, with the best source, to the replay's report."""
    from millwatch.plans.q_rows import _scratch

    path = _scratch(spark, "policy")
    best = metrics.best_threshold(sweep(spark, sf_dir)).first()["threshold"]
    sliding.save_policy(spark, sliding.Policy(threshold_high=best), path)
    o = X.oof3(spark, sf_dir)
    out = sliding.replay_report({name: o.withColumn("pred", F.col(c)) for name, c in (("first", "p1"), ("second", "p2"), ("mean", "p3"))}, sliding.load_policy(spark, path), 1000)
    whole = ["source", "inspection_budget_pct", "batch_size", "batches"]
    return out.select(*whole, *[F.round(c, 9).alias(c) for c in ("source_mcc", "threshold_high")], *[F.round(f"{c}_{f}", 6).alias(f"{c}_{f}") for c in sliding.SIGNALS for f in ("mean", "std")])


@query("a25_uniqueness_gate", f"""{WP}, v AS (SELECT round_even("L0_S1_F1", 6) AS a, round_even("L0_S1_F2", 6) AS b FROM parts WHERE coalesce("L0_S1_F1", "L0_S1_F2") IS NOT NULL), n AS (SELECT a, b, count(*) AS n FROM v GROUP BY 1, 2)
  SELECT CAST(sum(n) AS BIGINT) AS valid, count(*) AS distinct_values, count(*) >= 0.01 * sum(n) AS use_counts FROM n""")
def a25(spark, sf_dir):
    return encode.uniqueness_gate(parts(spark, sf_dir), ["L0_S1_F1", "L0_S1_F2"])


@query("u1_union", f"{S}, {SWEEP}, {BUDGET} SELECT 'sweep' AS source, threshold, tp, fp FROM sweep UNION ALL SELECT 'budget', score_cutoff, tp, fp FROM budget")
def u1(spark, sf_dir):
    a = sweep(spark, sf_dir).select(F.lit("sweep").alias("source"), "threshold", "tp", "fp")
    return a.unionByName(budget(spark, sf_dir).select(F.lit("budget").alias("source"), F.col("score_cutoff").alias("threshold"), "tp", "fp"))


@query("u3_group_overlap", f"WITH {FOLDED} SELECT path_signature, count(DISTINCT cv_fold) AS folds FROM fparts GROUP BY 1 HAVING count(DISTINCT cv_fold) > 1")
def u3(spark, sf_dir):
    return folds.group_overlap(folded_parts(spark, sf_dir), "path_signature")


@query("u4_distinct_signatures", f"{P} SELECT DISTINCT path_signature FROM signed")
def u4(spark, sf_dir):
    return signed(spark, sf_dir).select("path_signature").distinct()


@query("m1_group_folds", f"WITH {CHUNKED}, {folds_sql('chunked', 'chunk_id')} SELECT grp AS chunk_id, cv_fold FROM folds")
def m1(spark, sf_dir):
    return folds.group_folds(chunked(spark, sf_dir), "chunk_id")


@query("m2_row_folds", f'WITH {CHUNKED}, {folds_sql("chunked", "chunk_id")} SELECT "Id", chunk_id, cv_fold FROM chunked c JOIN folds f ON c.chunk_id = f.grp')
def m2(spark, sf_dir):
    c = chunked(spark, sf_dir)
    return folds.assign_folds(c, folds.group_folds(c, "chunk_id"), "chunk_id").select("Id", "chunk_id", "cv_fold")


