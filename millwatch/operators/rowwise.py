"""Features of one part from its own columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millwatch.functions import numbers as N
from millwatch.functions.columns import StationCatalog

EMPTY_BASELINE, EMPTY_PIPELINE = "__none__", "no_stations"
#: Records an hour, a day, a week, in the date block's unit.
HOUR, DAY, WEEK = 10, 240, 1680


def core_numbers(df: DataFrame, cols: list[str]) -> DataFrame:
    """feature_mean, feature_std, feature_min, feature_range and the null share times the deviation."""
    lo, hi = N.min_of(cols), N.max_of(cols)
    d = df.withColumn("feature_mean", N.mean_of(cols)).withColumn("feature_std", N.std_of(cols, F.col("feature_mean")))
    return d.withColumns({"feature_min": lo, "feature_range": hi - lo, "null_share_x_std": N.null_share(cols) * F.col("feature_std")})


def station_statistics(df: DataFrame, stations: list[str], catalog: StationCatalog) -> DataFrame:
    """Deviation and minimum of each named station's measures."""
    return df.withColumns({f"{s}_{k}": f(catalog.of_kind("F", s)) for s in stations for k, f in (("std", N.std_of), ("min", N.min_of))})


def start_end(df: DataFrame, cols: list[str], fill_duration: bool = True) -> DataFrame:
    lo, hi = N.min_of(cols), N.max_of(cols)
    d = hi - lo
    return df.withColumns({"start_time": lo, "end_time": hi, "duration": F.coalesce(d, F.lit(0.0)) if fill_duration else d})


def entry_times(df: DataFrame, catalog: StationCatalog) -> DataFrame:
    return df.withColumns({f"entry_{s}": N.min_of(catalog.of_kind("D", s)) for s in catalog.stations})


def line_times(df: DataFrame, catalog: StationCatalog, lines: tuple[int, ...] = (0, 1, 2, 3)) -> DataFrame:
    """Start, end and duration over entry times, over all stations and for each line, and the timed stations."""
    all_of = [f"entry_{s}" for s in catalog.stations]
    out = {"start_time": N.min_of(all_of), "end_time": N.max_of(all_of), "duration": N.max_of(all_of) - N.min_of(all_of), "timed_stations": N.count_of(all_of)}
    for k in lines:
        mine = [c for c in all_of if c.startswith(f"entry_L{k}_")]
        out |= {f"start_L{k}": N.min_of(mine), f"end_L{k}": N.max_of(mine), f"duration_L{k}": N.max_of(mine) - N.min_of(mine)}
    return df.withColumns(out)


def visited(df: DataFrame, catalog: StationCatalog, kind: str = "D") -> DataFrame:
    return df.withColumns({f"visited_{s}": N.any_of(catalog.of_kind(kind, s)) for s in catalog.stations})


def station_counts(df: DataFrame, catalog: StationCatalog, lines: tuple[int, ...] = (0, 1, 2, 3)) -> DataFrame:
    """station_count and station_count_L<line> from the visited flags."""
    flags = {s: F.col(f"visited_{s}") for s in catalog.stations}
    out = {"station_count": N.add([F.lit(0), *flags.values()])}
    out |= {f"station_count_L{k}": N.add([F.lit(0), *[c for s, c in flags.items() if s.startswith(f"L{k}_")]]) for k in lines}
    return df.withColumns(out)


def signature(catalog: StationCatalog, empty: str = EMPTY_BASELINE) -> Column:
    """Visited stations joined by |, from the visited flags."""
    s = F.concat_ws("|", *[F.when(F.col(f"visited_{x}") == 1, F.lit(x)) for x in catalog.stations])
    return F.when(s == "", F.lit(empty)).otherwise(s)


def calendar(df: DataFrame, start: str = "start_time") -> DataFrame:
    x = F.col(start)
    return df.withColumns({"week_time": F.pmod(x, F.lit(float(WEEK))), "day_of_week": F.pmod(F.floor(x / DAY), F.lit(7)), "hour_of_day": F.pmod(F.floor(x / HOUR), F.lit(24))})


def duration_flags(df: DataFrame, fitted: DataFrame, duration: str = "duration") -> DataFrame:
    """log, z-score and long/short flags against one row of fitted mean, std, p90, p10."""
    d = F.col(duration)
    out = df.crossJoin(F.broadcast(fitted.select("mean", "std", "p90", "p10")))
    return out.withColumns({"log_duration": F.log1p(d), "duration_z": (d - F.col("mean")) / F.col("std"), "is_long": F.coalesce((d >= F.col("p90")).cast("int"), F.lit(0)), "is_short": F.coalesce((d <= F.col("p10")).cast("int"), F.lit(0))}).drop("mean", "std", "p90", "p10")


def id_shift(df: DataFrame, row_id: str = "Id") -> DataFrame:
    """Id within the week, and the shift of the Id's hour: (0, 8] 0, (8, 16] 1, (16, 24] 2; hour 0 has none."""
    h = F.pmod(F.floor(F.col(row_id) / HOUR), F.lit(24))
    shift = F.when((h > 0) & (h <= 8), 0).when((h > 8) & (h <= 16), 1).when((h > 16) & (h <= 24), 2)
    return df.withColumns({"id_in_week": F.pmod(F.col(row_id), F.lit(WEEK)), "shift": shift})


def risk_tier(count: Column) -> Column:
    return F.when((count > 0) & (count <= 10), 0).when((count > 10) & (count <= 100), 1).when(count > 100, 2)


def fill_start(df: DataFrame, key: str = "start_time", position: str = "Id") -> DataFrame:
    """fill_time: the key; where null, one less than the smallest key; where no key exists, the row's place."""
    low = df.agg(F.min(key).alias("_low"))
    from millwatch.operators.ordering import global_index

    placed = global_index(df, position, position, "_place")
    return placed.crossJoin(F.broadcast(low)).withColumn("fill_time", F.coalesce(F.col(key), F.col("_low") - 1, F.col("_place").cast("double"))).drop("_low", "_place")


def select_block(df: DataFrame, wanted: list[str], derived: dict[str, Column]) -> DataFrame:
    """Wanted columns: the raw one if there is one, a derived one if known, else null."""
    return df.select("Id", *[F.col(c) if c in df.columns else derived.get(c, F.lit(None).cast("double")).alias(c) for c in wanted if c != "Id"])


def action(score: Column, threshold: float = 0.5) -> Column:
    return F.when(score >= threshold, "auto_reject").otherwise("pass")


def split_scores(df: DataFrame, score: str, threshold: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(rows with an action, rows whose score is no number in [0, 1])."""
    ok = F.coalesce((F.col(score) >= 0) & (F.col(score) <= 1), F.lit(False))
    return df.where(ok).withColumn("action", action(F.col(score), threshold)), df.where(~ok)


def drop_identifiers(df: DataFrame, names: tuple[str, ...] = ("id", "response")) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.lower() in names])
