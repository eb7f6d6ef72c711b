"""Fitted feature state as tables, and the contract that scored rows keep."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from millwatch.functions import numbers as N
from millwatch.functions.columns import StationCatalog
from millwatch.operators import encode, history, joins, ordering, paths, rowwise, runs
from millwatch.sources import io
from millwatch.sources.io import stored

#: Names that tell the future.
LEAKY = ("mean_timediff_till_next_",)


def impute(df: DataFrame, medians: DataFrame, text_fill: str = "unknown_path") -> DataFrame:
    """Nulls of numbers become their fitted median, nulls of text the fill. The medians are one row a column."""
    fills = medians.groupBy().agg(F.map_from_entries(F.collect_list(F.struct("col", "median"))).alias("_m"))
    known = df.crossJoin(F.broadcast(fills))
    out = {c: F.coalesce(F.col(c), F.try_element_at(F.col("_m"), F.lit(c)), F.lit(0.0)) if t == "double" else F.coalesce(F.col(c), F.lit(text_fill)) for c, t in df.dtypes if t in ("double", "string")}
    return known.withColumns(out).drop("_m")


def align(df: DataFrame, contract: list[tuple[str, str, object]], carry: tuple[str, ...] = ()) -> DataFrame:
    """Columns of the contract (name, type, fill), in its order: missing ones filled, others dropped, nulls filled,
    whole numbers rounded half to even. carry: columns that go along as they are."""
    cols = []
    for name, kind, fill in contract:
        c = F.col(name) if name in df.columns else F.lit(None)
        if kind in ("tinyint", "smallint", "int", "bigint"):
            c = F.bround(c.cast("double"))
        cols.append(F.coalesce(c.cast(kind), F.lit(fill).cast(kind)).alias(name))
    return df.select(*cols, *carry)


def guard(df: DataFrame, features: list[str], check_nulls: bool = True) -> DataFrame:
    """(check, columns, passed): missing features, names that tell the future, features that still hold nulls."""
    missing = [c for c in features if c not in df.columns]
    leaky = [c for c in df.columns if c.lower().startswith(LEAKY)]
    here = [c for c in features if c in df.columns]
    nulls = F.array_join(F.filter(F.array(*[F.when(F.count_if(F.col(c).isNull()) > 0, F.lit(c)) for c in here]), lambda x: x.isNotNull()), ",") if check_nulls and here else F.lit("")
    rows = df.agg(nulls.alias("n")).select(F.explode(F.array(*[F.struct(F.lit(k).alias("check"), v.alias("columns")) for k, v in (("missing", F.lit(",".join(missing))), ("leaky", F.lit(",".join(leaky))), ("nulls", F.col("n")))])).alias("r")).select("r.*")
    return rows.withColumn("passed", F.col("columns") == "")


@dataclass
class State:
    """Tables: encodings (col, value, rate), paths (path_signature, n, rate), scalars (one row), medians (col, median),
    mean (one row), contract (place, name, kind, fill)."""

    encodings: DataFrame
    paths: DataFrame
    scalars: DataFrame
    medians: DataFrame
    mean: DataFrame
    contract: DataFrame

    NAMES = ("encodings", "paths", "scalars", "medians", "mean", "contract")

    def save(self, path: str) -> None:
        """As a new version, which readers see when all its tables are written."""
        with io.new_version(self.mean.sparkSession, path) as folder:
            for n in self.NAMES:
                getattr(self, n).write.parquet(f"{folder}/{n}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> State:
        folder = io.last_version(spark, path)
        return cls(*[spark.read.parquet(f"{folder}/{n}") for n in cls.NAMES])

    def columns(self) -> list[tuple[str, str, object]]:
        """The contract as align() takes it; a row a feature."""
        rows = self.contract.orderBy("place").collect()
        return [(r["name"], r["kind"], r["fill"] if r["kind"] == "string" else float(r["fill"])) for r in rows]


#: Stations whose repeated measures are counted as they are, and rounded; those with their own statistics.
DUPLICATES = ("L0_S0", "L0_S12", "L3_S29", "L3_S30", "L3_S33")
ROUNDED = (*DUPLICATES, "L3_S35")
STATISTICS = ("L3_S24", "L3_S26")
HISTORY = (1, 5, 10)
#: The width in which records count as simultaneous.
SAME = 0.01


@dataclass(frozen=True)
class Stations:
    """Stations of the blocks that name some; those that a table lacks are left out."""

    duplicates: tuple[str, ...] = DUPLICATES
    rounded: tuple[str, ...] = ROUNDED
    statistics: tuple[str, ...] = STATISTICS


def raw_end(df: DataFrame) -> Column:
    return N.max_of(StationCatalog.of(df.columns).of_kind("D"))


@dataclass(frozen=True)
class Raw:
    """Rows with the features that depend on no fitted value, times as they are; the names of all and of the times. known:
    the rows have the other features too, by the state that was fitted on them, and no raw columns of stations."""

    rows: DataFrame
    made: list[str]
    times: list[str]
    known: bool = False


def raw(df: DataFrame, stations: Stations = Stations()) -> Raw:
    """What fit() and transform() start from, stored, so that both may share it where they see the same rows. Each block
    that orders or groups rows takes a row's number and the few columns it needs; blocks meet the rows by that number, so
    only raw columns are shuffled, once, and no block's order decides how many tasks the next one has. What a row says
    alone is not stored, but made where it is asked for."""
    catalog = StationCatalog.of(df.columns)
    measures, has = catalog.of_kind("F"), lambda names: {s: catalog.of_kind("F", s) for s in names if catalog.of_kind("F", s)}
    since = lambda d, e: [c for c in d.columns if c not in set(e.columns)]
    signed = rowwise.visited(df, catalog, "F").withColumns({"path_signature": rowwise.signature(catalog, rowwise.EMPTY_PIPELINE), "_t": N.min_of(catalog.of_kind("D")), "_row": F.monotonically_increasing_id()})
    rows = stored(signed.select(*df.columns, "path_signature", "_t", "_row"), "rows")
    n = rows.count()
    # duplicates, in the order of time and id; records around, in that of id
    slim = lambda names: rows.select("_row", "Id", "_t", *dict.fromkeys(names))
    some = lambda of: [x for names in of.values() for x in names]
    again, alike = has(stations.duplicates), has(stations.rounded)
    blocks = [
        runs.adjacent_runs(slim(measures), measures, "_t", rows=n, keep=False),
        runs.station_duplicates(slim(some(again)), again, "_t", at_hand=True).drop(*some(again)),
        runs.rounded_duplicates(slim(some(alike)), alike).drop(*some(alike)),
        history.records_around(slim([]), rows=n),
    ]
    blocks = [x.drop("Id", "_t") for x in blocks]
    met = paths.frequency(rows.drop("_t"), "path_signature", "path_count").withColumn("path_risk_tier", rowwise.risk_tier(F.col("path_count")))
    for x in blocks:
        met = met.join(x, "_row")
    met = stored(met.drop("_row"), "raw")
    # of a row alone
    a = rowwise.station_statistics(rowwise.core_numbers(met, measures), list(has(stations.statistics)), catalog)
    b = rowwise.station_counts(rowwise.visited(a, catalog, "F"), catalog)
    c = rowwise.calendar(rowwise.line_times(rowwise.entry_times(b, catalog), catalog))
    d = rowwise.id_shift(c)
    named = [[x for x in block.columns if x != "_row"] for block in blocks]
    times = [x for x in since(c, b) if x != "timed_stations"]
    made = [*since(a, met), *named[0], *named[1], *named[2], *since(b, a), "path_signature", "path_count", "path_risk_tier", *since(c, b), *named[3], *since(d, c)]
    return Raw(d.select(*df.columns, *made), made, times)


def _known(b: DataFrame, state_of: dict[str, DataFrame], cats: list[str], times: list[str]) -> DataFrame:
    """b (stored) with the features that depend on fitted tables. Nothing is stored between: what is asked of all rows, their
    times, needs few columns of b."""
    b = encode.apply_encoding(b, state_of["encodings"], cats, state_of["mean"])
    b = joins.lookup(b, state_of["paths"], "path_signature", "rate", state_of["mean"], "path_failure_rate")
    b = rowwise.duration_flags(b, state_of["scalars"])
    fills = {r["col"]: r["median"] for r in state_of["medians"].where(F.col("col").isin(times)).collect()}  # a row a time
    b = b.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(float(fills.get(c) or 0.0))) for c in times})
    return ordering.around_count(b, "start_time", SAME, "records_same")


def _looking_back(b: DataFrame, failures: DataFrame | None) -> DataFrame:
    """b with the time since failures, null without any, in its place."""
    since, last = [f"since_last_{k}" for k in HISTORY], "records_same"
    out = b.withColumns({c: F.lit(None).cast("double") for c in since}) if failures is None else history.since_failures(b, failures, "end_time", "time", "failure_id", HISTORY)
    return out.select(*[c for c in b.columns if c != last], *since, last)


def _kind(t: str) -> str:
    return t if t in ("tinyint", "smallint", "int", "bigint", "string") else "double"


def fit(df: DataFrame, target: str = "Response", stations: Stations = Stations(), made: Raw | None = None) -> State:
    """The state of a labelled table; fitting changes nothing else. Its own failures are the history of its rows. made:
    raw() of df, where the caller has it."""
    return fit_known(df, target, stations, made)[0]


def fit_known(df: DataFrame, target: str = "Response", stations: Stations = Stations(), made: Raw | None = None) -> tuple[State, Raw]:
    """fit(), and its rows with the features that the state gives them, which transform() of the same rows by this state
    takes as `made`: only their history, which the context decides, is made again."""
    catalog = StationCatalog.of(df.columns)
    made = made or raw(df, stations)
    b, times = made.rows, made.times
    cats, spark = catalog.of_kind("C"), df.sparkSession
    of = {"encodings": encode.target_encoding(b, cats, target), "paths": paths.smoothed_rate(b, "path_signature", target), "scalars": encode.scalars(b, "duration", at_hand=True), "mean": b.agg(F.avg(target).alias("mean")), "medians": encode.medians(b, times, at_hand=True)}
    of = {k: stored(v, k) for k, v in of.items()}
    filled_end = F.coalesce(F.col("end_time").cast("double"), F.lit(of["medians"].where("col = 'end_time'").first()["median"]))
    failures = b.where(F.col(target) == 1).select(filled_end.alias("time"), F.col("Id").alias("failure_id"))
    stay = [c for c in df.columns if c not in {x for kind in "FDC" for x in catalog.of_kind(kind)}]
    full = _looking_back(_known(b, of, cats, times), failures)
    kinds = {c: _kind(t) for c, t in full.dtypes if c not in df.columns}
    full = stored(full.select(*stay, *kinds), "full")
    medians = stored(encode.medians(full, [c for c, t in kinds.items() if t != "string"], at_hand=True), "medians")
    fill = {r["col"]: r["median"] for r in medians.collect()}  # a row a feature
    told = [(i, c, t, ("unknown_path" if c == "path_signature" else "") if t == "string" else repr(float(fill[c]))) for i, (c, t) in enumerate(kinds.items())]
    fitted = State(of["encodings"], of["paths"], of["scalars"], medians, of["mean"], spark.createDataFrame(told, "place int, name string, kind string, fill string"))
    return fitted, Raw(full.drop(*[f"since_last_{k}" for k in HISTORY]), list(kinds), times, True)


def failures_of(context: DataFrame) -> DataFrame:
    """(time, failure_id) of a context's failures: it has Response, and end_time or the raw times."""
    if "Response" not in context.columns:
        raise ValueError("the context has no Response")
    end = F.col("end_time") if "end_time" in context.columns else raw_end(context)
    return context.where("Response = 1").select(end.cast("double").alias("time"), F.col("Id").alias("failure_id")).where("time is not null")


def transform(df: DataFrame, state: State, context: DataFrame | None = None, allow_fallback: bool = True, stations: Stations = Stations(), made: Raw | None = None, carry: tuple[str, ...] = ()) -> tuple[DataFrame, dict]:
    """(Id and the contract's features, info). context: labelled rows to look back on. Without usable failures the
    history's fitted medians stand in, and info warns, unless allow_fallback is off. made: raw() of the same rows, or what
    fit_known() gave with this state. carry: columns of made's rows that go along."""
    catalog = StationCatalog.of(df.columns)
    info: dict = {"temporal_context_used": False, "temporal_fallback_used": False, "warnings": []}
    failures = None if context is None else failures_of(context)
    if failures is not None and not failures.take(1):
        failures = None
    why = "no context to look back on" if context is None else "the context holds no usable failure"
    if failures is not None:
        info["temporal_context_used"] = True
    elif not allow_fallback:
        raise ValueError(f"{why}, and falling back is switched off")
    else:
        info["temporal_fallback_used"] = True
        info["warnings"].append(f"{why}: fitted medians stand in for the time since failures")
    made = made or raw(df, stations)
    known = made.rows if made.known else _known(made.rows, {n: getattr(state, n) for n in State.NAMES}, catalog.of_kind("C"), made.times)
    full = _looking_back(known, failures)
    contract = state.columns()
    info["missing_features"] = [name for name, _, _ in contract if name not in full.columns]
    return align(full, [("Id", "bigint", 0), *contract], carry), info


def prepare(df: DataFrame, state: State, context: DataFrame | None = None, allow_fallback: bool = True, stations: Stations = Stations(), made: Raw | None = None, carry: tuple[str, ...] = (), folds: Column | None = None) -> tuple[DataFrame, dict]:
    """transform(), stored and checked: an error where a name tells the future or a feature holds nulls. Nulls are counted
    while the table is written (`observe`), so checking reads nothing again; info has the rows. folds: cv_fold of the rows,
    which lie by it then, so that training needs no table of its own."""
    out, info = transform(df, state, context, allow_fallback, stations, made, carry)
    by = None if folds is None else ["cv_fold"]
    out = out if folds is None else out.withColumn("cv_fold", folds)
    features = [n for n, _, _ in state.columns()]
    seen = Observation("features")
    counts = [F.count_if(F.col(c).isNull()).alias(f"n{i}") for i, c in enumerate(features)]
    out = stored(out.observe(seen, F.count(F.lit(1)).alias("rows"), *counts), "prepared", by=by)
    told = seen.get
    info["rows"] = told["rows"]
    leaky = [c for c in out.columns if c.lower().startswith(LEAKY)]
    nulls = [c for i, c in enumerate(features) if told[f"n{i}"]]
    bad = [(check, ",".join(names)) for check, names in (("leaky", leaky), ("nulls", nulls)) if names]
    if bad:
        raise ValueError(f"features are not fit for a model: {bad}")
    return out, info
