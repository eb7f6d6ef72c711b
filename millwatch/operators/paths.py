"""Path signatures as tokens, transitions and pairs, and what groups of signatures say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millwatch.operators.ordering import meet_groups
from millwatch.operators.rowwise import EMPTY_BASELINE
from millwatch.sources.io import stored


def parse(sig: Column, empty: str = EMPTY_BASELINE) -> Column:
    s = F.when(sig.isNull() | (sig == empty), F.lit("")).otherwise(sig)
    return F.filter(F.split(s, r"\|"), lambda x: x != "")


def transitions(tokens: Column) -> Column:
    n = F.size(tokens)
    steps = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.concat(F.get(tokens, i - 1), F.lit(">"), F.get(tokens, i)))
    return F.when(n > 1, steps).otherwise(F.array().cast("array<string>"))


def pairs(tokens: Column) -> Column:
    n = F.size(tokens)
    rows = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.transform(F.slice(tokens, i + 1, n), lambda b: F.concat(F.get(tokens, i - 1), F.lit("&"), b)))
    return F.when(n > 1, F.flatten(rows)).otherwise(F.array().cast("array<string>"))


def frequency(df: DataFrame, col: str, out: str) -> DataFrame:
    """df with the number of rows that share the column's value, nulls among themselves; heavy values meet theirs apart."""
    per = df.groupBy(col).agg(F.count("*").alias("_n"), F.count("*").alias(out))
    return meet_groups(df, per, [col], "_n")


def smoothed_rate(df: DataFrame, key: str, target: str = "Response", weight: float = 10.0) -> DataFrame:
    """(key, n, rate): the key's failure rate drawn to the overall one by `weight` rows."""
    mean = df.agg(F.avg(target).alias("_g"))
    per = df.groupBy(key).agg(F.count("*").alias("n"), F.sum(target).alias("_s"))
    return per.crossJoin(F.broadcast(mean)).select(key, "n", ((F.col("_s") + weight * F.col("_g")) / (F.col("n") + weight)).alias("rate"))


def pair_cooccurrence(df: DataFrame, sig: str = "path_signature") -> DataFrame:
    """(signature, mean, max, std of the weights of its pairs); a pair weighs the rows of all signatures with it. Pairs
    are made once a distinct signature: signatures are stored first, as Spark would push the question whether a signature
    has pairs down to the rows, and read these once for each use."""
    per = stored(df.groupBy(sig).agg(F.count("*").alias("_n")), "signatures").withColumn("_p", pairs(parse(F.col(sig))))
    each = per.select(sig, "_n", F.explode("_p").alias("_pair"))
    weight = each.groupBy("_pair").agg(F.sum("_n").alias("_w"))
    stats = each.join(weight, "_pair").groupBy(F.col(sig).alias("_s")).agg(F.avg("_w").alias("a"), F.max("_w").alias("b"), F.stddev_pop("_w").alias("c"))
    out = per.join(stats, per[sig].eqNullSafe(stats["_s"]), "left")
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    return out.select(sig, zero("a").alias("pair_cooccur_mean"), zero("b").alias("pair_cooccur_max"), zero("c").alias("pair_cooccur_std"))
