"""The three feature datasets, composed of operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millwatch.functions import numbers as N
from millwatch.functions.columns import StationCatalog
from millwatch.operators import encode, folds, history, ordering, paths, rowwise
from millwatch.sources.io import stored


def baseline(df: DataFrame, numeric: list[str], dates: list[str], chunk: int = 10000) -> DataFrame:
    """Times, mean measure, path, density in time and time chunks of each part. Null start times stay null in the
    output and count as one unit before the first."""
    if chunk <= 0:
        raise ValueError("chunk size must be positive")
    catalog = StationCatalog.of([*numeric, *dates])
    d = rowwise.start_end(rowwise.visited(df, catalog), dates)
    d = d.select("Id", "Response", "start_time", "duration", F.coalesce(N.mean_of(numeric), F.lit(0.0)).alias("feature_mean"), rowwise.signature(catalog).alias("path_signature"), N.add([F.col(f"visited_{s}") for s in catalog.stations]).alias("station_count"))
    d = stored(d, "core")
    n = d.count()
    d = paths.frequency(d, "path_signature", "path_count")
    low = d.agg(F.min("start_time").alias("_low"))
    d = d.crossJoin(F.broadcast(low)).withColumn("_ft", F.coalesce("start_time", F.col("_low") - 1, F.lit(0.0))).drop("_low")
    d = ordering.trailing_counts(d, "_ft", "Id", {"records_last_1hr": 1.0, "records_last_24hr": 24.0}, place="_i", n=n)
    d = d.withColumn("density_ratio", F.col("records_last_1hr") / F.greatest("records_last_24hr", F.lit(1)))
    d = stored(d.withColumn("chunk_id", F.expr(f"cast(_i div {chunk} as int)")), "chunks")
    return paths.frequency(d, "chunk_id", "chunk_size").drop("_ft", "_i")


def with_folds(df: DataFrame, group: str = "chunk_id", n: int = 5, once: bool = False) -> DataFrame:
    """df with cv_fold. once: the caller reads the rows once, so that they are not stored with their folds."""
    df = stored(df, "base")
    out = folds.assign_folds(df, folds.group_folds(df, group, folds=n), group, check=False)
    return out if once else stored(out, "folds")


def dataset_g(df: DataFrame, rolling: int = 10000) -> DataFrame:
    """Out-of-fold rates by chunk and signature, the trailing rate of earlier parts, and interactions."""
    d = encode.oof_rate(df, "chunk_id", out="chunk_failure_rate")
    d = encode.oof_rate(d, "path_signature", out="signature_failure_rate")
    d = history.oof_trailing_rate(stored(d, "rates"), rows=rolling, out="rolling_fail_rate_w10000")
    d = d.withColumn("path_failure_rate", F.col("signature_failure_rate"))
    return d.withColumns({"duration_x_path_failure_rate": F.col("duration") * F.col("path_failure_rate"), "feature_mean_x_duration": F.col("feature_mean") * F.col("duration")})


def dataset_h(df: DataFrame) -> DataFrame:
    """Out-of-fold risk of a part's stations and transitions, and how common its station pairs are. Statistics are made
    once for each signature and fold."""
    tokens = encode.tokens_of("path_signature")
    steps = paths.transitions(tokens)
    a = encode.signature_token_stats(df, "path_signature", steps, encode.oof_token_rates(df, "path_signature", steps), ("transition_fail_rate_mean", "transition_fail_rate_max", "transition_fail_rate_std"))
    b = encode.signature_token_stats(df, "path_signature", tokens, encode.oof_token_rates(df, "path_signature", tokens), ("station_risk_mean", "_m", "_s")).drop("_m", "_s")
    c = paths.pair_cooccurrence(df)
    key = ["path_signature", "cv_fold"]
    sizes = stored(df.groupBy(*key).agg(F.count("*").alias("_n")), "signatures")
    # all figures of a signature and fold are one row, which its rows meet once, heavy signatures apart
    same = lambda x, y, on: [x[k].eqNullSafe(y[k]) for k in on]
    per = sizes
    for more, on in ((a, key), (b, key), (c, key[:1])):
        per = per.join(more, same(per, more, on), "left").select(per["*"], *[more[x] for x in more.columns if x not in on])
    return ordering.meet_groups(df, per, key, "_n")
