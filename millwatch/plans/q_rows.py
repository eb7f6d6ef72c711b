"""Queries of scans, sinks and row-wise features."""

from __future__ import annotations

from pyspark.sql import functions as F

from millwatch.functions import numbers as N
from millwatch.functions.columns import StationCatalog
from millwatch.operators import encode, paths, rowwise, state
from millwatch.plans import fixtures as X
from millwatch.plans.registry import query
from millwatch.sources import io

CATALOG = StationCatalog.of([*X.NUMERIC, *X.DATES, *X.CATEGORIES])
q = lambda c: f'"{c}"'
F_COLS = ", ".join(map(q, X.NUMERIC))
D_COLS = ", ".join(map(q, X.DATES))
_LIST = f"list_filter([{F_COLS}], lambda x: x IS NOT NULL)"
_DLIST = f"list_filter([{D_COLS}], lambda x: x IS NOT NULL)"
ENTRY = ", ".join(f'"{s}_D1" AS "entry_{s}"' for s in X.STATIONS)
VISITED = ", ".join(f'CAST("{s}_D1" IS NOT NULL AS INTEGER) AS "visited_{s}"' for s in X.STATIONS)
FLAGS = f'flags AS (SELECT "Id", "Response", {VISITED} FROM parts)'
SIG = "concat_ws('|', " + ", ".join(f"CASE WHEN \"visited_{s}\" = 1 THEN '{s}' END" for s in CATALOG.stations) + ")"
SIGNED = f"""{FLAGS}, signed AS (SELECT "Id", "Response", CASE WHEN {SIG} = '' THEN '__none__' ELSE {SIG} END AS path_signature FROM flags)"""
START = f"""starts AS (SELECT "Id", "Response", least({D_COLS}) AS start_time, greatest({D_COLS}) AS end_time, coalesce(greatest({D_COLS}) - least({D_COLS}), 0) AS duration FROM parts)"""
WP = f"WITH {X.PARTS}"


def parts(spark, sf_dir):
    return X.parts_wide(spark, sf_dir)


def started(spark, sf_dir):
    return rowwise.start_end(parts(spark, sf_dir), X.DATES)


def signed(spark, sf_dir):
    d = rowwise.visited(parts(spark, sf_dir), CATALOG)
    return d.withColumn("path_signature", rowwise.signature(CATALOG)).select("Id", "Response", "path_signature")


def _scratch(spark, name):
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/millwatch-io-{uuid.uuid4().hex}/{name}"


@query("s1_csv_to_parquet", f"""{WP} SELECT "Id", CAST("Response" AS TINYINT) AS "Response", {", ".join(f'CAST({q(c)} AS FLOAT) AS {q(c)}' for c in (*X.NUMERIC, *X.DATES))}, {", ".join(map(q, X.CATEGORIES))} FROM parts""")
def s1(spark, sf_dir):
    p = parts(spark, sf_dir)
    src, out = _scratch(spark, "csv"), _scratch(spark, "parquet")
    io.write_csv(p, f"{src}/part_a")
    io.csv_to_parquet(spark, src, out, p.columns)
    return spark.read.parquet(out)


@query("s2_types", f"""{WP} SELECT CAST("Id" AS BIGINT) AS "Id", CAST("Response" AS TINYINT) AS "Response", {", ".join(f'CAST({q(c)} AS FLOAT) AS {q(c)}' for c in X.NUMERIC)}, CAST("Id" % 100 AS TINYINT) AS small, CAST("Id" % 100 * 300 AS SMALLINT) AS middle FROM parts""")
def s2(spark, sf_dir):
    d = parts(spark, sf_dir).select("Id", "Response", *X.NUMERIC, (F.col("Id") % 100).alias("small"), (F.col("Id") % 100 * 300).alias("middle"))
    kinds = io.narrowest(d, ["small", "middle"])
    return io.optimize_types(d.select(*[F.col(c).cast("string").alias(c) for c in d.columns]), kinds)


@query("s4_scan", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders")
def s4(spark, sf_dir):
    return X.load(spark, sf_dir, "orders").drop("o_orderdate")


@query("s5_pruned_scan", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000")
def s5(spark, sf_dir):
    return X.load(spark, sf_dir, "orders").where("o_totalprice > 100000").select("o_orderkey", "o_totalprice")


@query("s6_csv_tables")
def s6(spark, sf_dir):
    from millwatch.operators import metrics

    s = metrics.threshold_sweep(X.scores(spark, sf_dir))
    folder = _scratch(spark, "tables")
    io.write_csv(s, f"{folder}/sweep.csv")
    ddl = ", ".join(f"{c} {t}" for c, t in s.dtypes)
    back = io.read_tables(spark, folder, {"sweep.csv": ddl})["sweep.csv"]
    return back.select("threshold", "tp", "fp", "fn", "tn", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "mcc", "positives_pct")])


@query("s7_parquet_sink", f'WITH {X.SCORES} SELECT * FROM scores')
def s7(spark, sf_dir):
    path = _scratch(spark, "sink")
    io.write_parquet(X.scores(spark, sf_dir), path)
    return spark.read.parquet(path)


@query("s8_csv_sink", f'WITH {X.SCORES} SELECT * FROM scores')
def s8(spark, sf_dir):
    path = _scratch(spark, "sink")
    s = X.scores(spark, sf_dir)
    io.write_csv(s, path)
    return spark.read.schema(s.schema).csv(path, header=True)


def rounded_batches(df, first):
    """The columns of batch metrics, measures rounded."""
    plain = ["rows", "auto_reject_count", "manual_inspect_count", "tp", "fp", "fn", "tn"]
    return df.select(*first, *plain, *[F.round(c, 6).alias(c) for c in ("precision", "recall", "flagged_pct", "pred_mean", "pred_std")])


@query("s9_append_log")
def s9(spark, sf_dir):
    from millwatch.operators import decide
    from millwatch.streaming import replay

    path = _scratch(spark, "log")
    m = replay.batch_metrics(decide.batches(X.scores(spark, sf_dir), 10000)).withColumnRenamed("batch", "batch_id")
    for _ in range(2):  # written twice, there once
        io.append_log(m, path)
    return rounded_batches(spark.read.parquet(path), ["batch_id", "batch_start", "batch_end"])


@query("s10_summary")
def s10(spark, sf_dir):
    from millwatch.operators import metrics

    path = _scratch(spark, "summary")
    best = metrics.best_threshold(metrics.threshold_sweep(X.scores(spark, sf_dir))).select(F.lit("first").alias("model"), "threshold", "mcc")
    io.write_summary(io.upsert(best, best.withColumn("mcc", F.col("mcc") + 1), "model"), path)
    return spark.read.schema(best.schema).json(path).withColumn("mcc", F.round("mcc", 9))


@query("p1_to_number", "SELECT o_orderkey, coalesce(TRY_CAST(split_part(o_orderpriority, '-', 1) AS DOUBLE), -1) AS level, coalesce(TRY_CAST(o_orderstatus AS DOUBLE), 0) AS status FROM orders")
def p1(spark, sf_dir):
    o = X.load(spark, sf_dir, "orders")
    return o.select("o_orderkey", N.to_number(F.split_part("o_orderpriority", F.lit("-"), F.lit(1)), -1).alias("level"), N.to_number("o_orderstatus", 0).alias("status"))


@query("p4_row_mean", f'{WP} SELECT "Id", round(list_avg({_LIST}), 6) AS feature_mean FROM parts')
def p4(spark, sf_dir):
    return parts(spark, sf_dir).select("Id", F.round(N.mean_of(X.NUMERIC), 6).alias("feature_mean"))


@query("p5_row_stats", f"""{WP} SELECT "Id", round(list_stddev_samp({_LIST}), 6) AS feature_std, list_min({_LIST}) AS feature_min, list_max({_LIST}) - list_min({_LIST}) AS feature_range,
  round(CASE WHEN "L1_S2_F1" IS NOT NULL AND "L1_S2_F2" IS NOT NULL THEN abs("L1_S2_F1" - "L1_S2_F2") / sqrt(2) END, 6) AS "L1_S2_std", least("L1_S2_F1", "L1_S2_F2") AS "L1_S2_min" FROM parts""")
def p5(spark, sf_dir):
    d = rowwise.station_statistics(rowwise.core_numbers(parts(spark, sf_dir), X.NUMERIC), ["L1_S2"], CATALOG)
    return d.select("Id", F.round("feature_std", 6).alias("feature_std"), "feature_min", "feature_range", F.round("L1_S2_std", 6).alias("L1_S2_std"), "L1_S2_min")


@query("p6_null_share_std", f'{WP} SELECT "Id", round((1 - len({_LIST}) / {len(X.NUMERIC)}.0::DOUBLE) * list_stddev_samp({_LIST}), 6) AS null_share_x_std FROM parts')
def p6(spark, sf_dir):
    return rowwise.core_numbers(parts(spark, sf_dir), X.NUMERIC).select("Id", F.round("null_share_x_std", 6).alias("null_share_x_std"))


@query("p7_start_end", f'{WP}, {START} SELECT "Id", start_time, end_time, duration FROM starts')
def p7(spark, sf_dir):
    return started(spark, sf_dir).select("Id", "start_time", "end_time", "duration")


@query("p8_entry_times", f'{WP} SELECT "Id", {ENTRY} FROM parts')
def p8(spark, sf_dir):
    return rowwise.entry_times(parts(spark, sf_dir), CATALOG).select("Id", *[f"entry_{s}" for s in X.STATIONS])


def _line_sql() -> str:
    out = []
    for k in range(4):
        cols = ", ".join(f'"{s}_D1"' for s in X.STATIONS if s.startswith(f"L{k}_"))
        one = cols.count(",") == 0
        lo, hi = (cols, cols) if one else (f"least({cols})", f"greatest({cols})")
        out.append(f'{lo} AS "start_L{k}", {hi} AS "end_L{k}", {hi} - {lo} AS "duration_L{k}"')
    return ", ".join(out)


@query("p9_line_times", f'{WP} SELECT "Id", least({D_COLS}) AS start_time, greatest({D_COLS}) AS end_time, greatest({D_COLS}) - least({D_COLS}) AS duration, CAST(len({_DLIST}) AS INTEGER) AS timed_stations, {_line_sql()} FROM parts')
def p9(spark, sf_dir):
    d = rowwise.line_times(rowwise.entry_times(parts(spark, sf_dir), CATALOG), CATALOG)
    return d.select("Id", "start_time", "end_time", "duration", "timed_stations", *[f"{c}_L{k}" for k in range(4) for c in ("start", "end", "duration")])


@query("p10_visited", f'{WP} SELECT "Id", {VISITED}, {", ".join(f"""CAST(coalesce("{s}_F1", "{s}_F2") IS NOT NULL AS INTEGER) AS "measured_{s}" """ for s in X.STATIONS)} FROM parts')
def p10(spark, sf_dir):
    p = parts(spark, sf_dir)
    return p.select("Id", *[N.any_of(CATALOG.of_kind("D", s)).alias(f"visited_{s}") for s in X.STATIONS], *[N.any_of(CATALOG.of_kind("F", s)).alias(f"measured_{s}") for s in X.STATIONS])


def _count_sql(k=None) -> str:
    return " + ".join(f'"visited_{s}"' for s in X.STATIONS if k is None or s.startswith(f"L{k}_"))


@query("p11_station_counts", f'{WP}, {FLAGS} SELECT "Id", {_count_sql()} AS station_count, {", ".join(f"{_count_sql(k)} AS station_count_L{k}" for k in range(4))} FROM flags')
def p11(spark, sf_dir):
    d = rowwise.station_counts(rowwise.visited(parts(spark, sf_dir), CATALOG), CATALOG)
    return d.select("Id", "station_count", *[f"station_count_L{k}" for k in range(4)])


@query("p12_signature", f"""{WP}, {FLAGS} SELECT "Id", CASE WHEN {SIG} = '' THEN '__none__' ELSE {SIG} END AS path_signature, CASE WHEN {SIG} = '' THEN 'no_stations' ELSE {SIG} END AS path FROM flags""")
def p12(spark, sf_dir):
    d = rowwise.visited(parts(spark, sf_dir), CATALOG)
    return d.select("Id", rowwise.signature(CATALOG).alias("path_signature"), rowwise.signature(CATALOG, rowwise.EMPTY_PIPELINE).alias("path"))


@query("p13_calendar", f"""{WP}, {START} SELECT "Id", start_time - 1680 * floor(start_time / 1680) AS week_time, CAST(floor(start_time / 240) - 7 * floor(floor(start_time / 240) / 7) AS BIGINT) AS day_of_week,
  CAST(floor(start_time / 10) - 24 * floor(floor(start_time / 10) / 24) AS BIGINT) AS hour_of_day FROM starts""")
def p13(spark, sf_dir):
    return rowwise.calendar(started(spark, sf_dir)).select("Id", "week_time", "day_of_week", "hour_of_day")


@query("p14_duration_flags", f"""{WP}, {START}, f AS (SELECT avg(duration) AS m, coalesce(nullif(stddev_samp(duration), 0), 1) AS s, quantile_cont(duration, 0.9) AS hi, quantile_cont(duration, 0.1) AS lo FROM starts)
  SELECT "Id", round(ln(1 + duration), 6) AS log_duration, round((duration - m) / s, 6) AS duration_z, CAST(duration >= hi AS INTEGER) AS is_long, CAST(duration <= lo AS INTEGER) AS is_short FROM starts, f""")
def p14(spark, sf_dir):
    s = started(spark, sf_dir)
    return rowwise.duration_flags(s, encode.scalars(s, "duration")).select("Id", F.round("log_duration", 6).alias("log_duration"), F.round("duration_z", 6).alias("duration_z"), "is_long", "is_short")


@query("p15_id_shift", f"""WITH {X.TICKS}, h AS (SELECT "Id", "Id" % 1680 AS id_in_week, ("Id" // 10) % 24 AS h FROM ticks)
  SELECT "Id", id_in_week, CASE WHEN h > 0 AND h <= 8 THEN 0 WHEN h > 8 AND h <= 16 THEN 1 WHEN h > 16 THEN 2 END AS shift FROM h""")
def p15(spark, sf_dir):
    return rowwise.id_shift(X.ticks(spark, sf_dir)).select("Id", "id_in_week", "shift")


@query("p16_risk_tier", f"""{WP}, {SIGNED}, c AS (SELECT "Id", count(*) OVER (PARTITION BY path_signature) AS path_count FROM signed)
  SELECT "Id", path_count, CASE WHEN path_count > 100 THEN 2 WHEN path_count > 10 THEN 1 WHEN path_count > 0 THEN 0 END AS risk_tier FROM c""")
def p16(spark, sf_dir):
    return paths.frequency(signed(spark, sf_dir), "path_signature", "path_count").select("Id", "path_count", rowwise.risk_tier(F.col("path_count")).alias("risk_tier"))


@query("p17_density_ratio", f'WITH {X.TICKS} SELECT "Id", value / greatest(t, 1) AS density_ratio FROM ticks')
def p17(spark, sf_dir):
    return X.ticks(spark, sf_dir).select("Id", (F.col("value") / F.greatest("t", F.lit(1.0))).alias("density_ratio"))


@query("p18_interactions", f"""{WP}, {START} SELECT s."Id", duration * CAST(s."Response" AS DOUBLE) AS duration_x_rate, round(list_avg({_LIST}) * duration + 1e-7, 2) AS feature_mean_x_duration FROM starts s JOIN parts p ON s."Id" = p."Id" """)
def p18(spark, sf_dir):
    d = rowwise.core_numbers(started(spark, sf_dir), X.NUMERIC)
    return d.select("Id", (F.col("duration") * F.col("Response").cast("double")).alias("duration_x_rate"), F.round(F.col("feature_mean") * F.col("duration") + 1e-7, 2).alias("feature_mean_x_duration"))


@query("p19_fill_start", f"""{WP}, {START} SELECT "Id", start_time, coalesce(start_time, min(start_time) OVER () - 1, CAST(row_number() OVER (ORDER BY "Id") - 1 AS DOUBLE)) AS fill_time FROM starts""")
def p19(spark, sf_dir):
    return rowwise.fill_start(started(spark, sf_dir)).select("Id", "start_time", "fill_time")


@query("p20_selected_block", f'{WP} SELECT "Id", "L0_S1_F1", round(list_avg({_LIST}), 6) AS feature_mean, CAST(NULL AS DOUBLE) AS "L9_S9_F9" FROM parts')
def p20(spark, sf_dir):
    return rowwise.select_block(parts(spark, sf_dir), ["L0_S1_F1", "feature_mean", "L9_S9_F9"], {"feature_mean": F.round(N.mean_of(X.NUMERIC), 6)})


@query("p21_impute", f"""{WP}, m AS (SELECT coalesce(median("L0_S1_F1"), 0) AS a, coalesce(median("L1_S2_F2"), 0) AS b FROM parts)
  SELECT "Id", coalesce("L0_S1_F1", a) AS "L0_S1_F1", coalesce("L1_S2_F2", b) AS "L1_S2_F2", coalesce("L0_S1_C1", 'unknown_path') AS "L0_S1_C1" FROM parts, m""")
def p21(spark, sf_dir):
    d = parts(spark, sf_dir).select("Id", "L0_S1_F1", "L1_S2_F2", "L0_S1_C1")
    return state.impute(d, encode.medians(d, ["L0_S1_F1", "L1_S2_F2"]))


CONTRACT = [("Id", "bigint", 0), ("L1_S2_F2", "float", 0.0), ("half", "int", 0), ("absent", "double", -1.0), ("L0_S1_C1", "string", "none")]


@query("p22_contract", f"""{WP} SELECT "Id", CAST(coalesce("L1_S2_F2", 0) AS FLOAT) AS "L1_S2_F2", CAST(coalesce(round_even("L0_S1_F1" / 2, 0), 0) AS INTEGER) AS half, CAST(-1 AS DOUBLE) AS absent, coalesce("L0_S1_C1", 'none') AS "L0_S1_C1" FROM parts""")
def p22(spark, sf_dir):
    return state.align(parts(spark, sf_dir).withColumn("half", F.col("L0_S1_F1") / 2), CONTRACT)


@query("p23_guard", f"""{WP}, n AS (SELECT count(*) FILTER ("L0_S1_F1" IS NULL) AS n FROM parts) SELECT 'missing' AS "check", 'L9_S9_F9' AS "columns", false AS passed
  UNION ALL SELECT 'leaky', 'mean_timediff_till_next_5', false UNION ALL SELECT 'nulls', CASE WHEN n > 0 THEN 'L0_S1_F1' ELSE '' END, n = 0 FROM n""")
def p23(spark, sf_dir):
    d = parts(spark, sf_dir).withColumn("mean_timediff_till_next_5", F.lit(0.0))
    return state.guard(d, ["L0_S1_F1", "L9_S9_F9", "Id"])


@query("p24_drop_identifiers", f'WITH {X.SCORES} SELECT pred FROM scores')
def p24(spark, sf_dir):
    return rowwise.drop_identifiers(X.scores(spark, sf_dir))


TOKENS = "CASE WHEN path_signature = '__none__' THEN CAST([] AS VARCHAR[]) ELSE string_split(path_signature, '|') END"


@query("p26_tokens", f"""{WP}, {SIGNED} SELECT "Id", array_to_string({TOKENS}, ',') AS tokens, CAST(len({TOKENS}) AS INTEGER) AS n FROM signed""")
def p26(spark, sf_dir):
    t = paths.parse(F.col("path_signature"))
    return signed(spark, sf_dir).select("Id", F.array_join(t, ",").alias("tokens"), F.size(t).alias("n"))


@query("p27_transitions", f"""{WP}, {SIGNED}, t AS (SELECT "Id", {TOKENS} AS k FROM signed)
  SELECT "Id", array_to_string(list_transform(range(1, len(k)), lambda i: k[i] || '>' || k[i + 1]), ',') AS transitions FROM t""")
def p27(spark, sf_dir):
    return signed(spark, sf_dir).select("Id", F.array_join(paths.transitions(paths.parse(F.col("path_signature"))), ",").alias("transitions"))


@query("p28_pairs", f"""{WP}, {SIGNED}, t AS (SELECT "Id", {TOKENS} AS k FROM signed)
  SELECT "Id", array_to_string(flatten(list_transform(range(1, len(k)), lambda i: list_transform(range(i + 1, len(k) + 1), lambda j: k[i] || '&' || k[j]))), ',') AS pairs FROM t""")
def p28(spark, sf_dir):
    return signed(spark, sf_dir).select("Id", F.array_join(paths.pairs(paths.parse(F.col("path_signature"))), ",").alias("pairs"))


@query("p29_action", f"WITH {X.SCORES} SELECT \"Id\", CASE WHEN pred >= 0.5 THEN 'auto_reject' ELSE 'pass' END AS action FROM scores WHERE pred >= 0 AND pred <= 1")
def p29(spark, sf_dir):
    return rowwise.split_scores(X.scores(spark, sf_dir), "pred")[0].select("Id", "action")
