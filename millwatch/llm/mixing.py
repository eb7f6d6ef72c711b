"""Mixing sources to target weights by Pareto order sampling.

Every source has a weight; targets share the total size by weight, none above `most` times its source's size, and
what is cut off goes to the others by weight (water filling, closed form over the sorted sources). A source whose
target is r times its size takes floor(r) whole copies of each document for certain; what is left of the target is
drawn without replacement: a document with inclusion probability p and a uniform number u ranks by
(u / (1 - u)) / (p / (1 - p)), smallest first, and documents are taken in that order until their words are as
near to the rest of the target as whole documents allow. With an `appeal` column p is proportional to it
(cut at 1), otherwise equal in a source.

u is a hash of the document's id and the seed, so a rerun takes the same. No source is ordered in one task: ranks are
cut into `bins` of (source, rank), sums of words per bin give the one bin in which the target ends, and only that
bin's documents are ordered. A bin that holds very many documents is cut again by the same rule.

Defined results: null text has size 0; a null source is a source of its own, last; rows with the same id share u and
are ordered by size and source; documents of size 0 take 0 words and 0 copies beyond the certain ones; null, zero or
negative appeal is the least there is; an empty table gives an empty result. An input column named like one of the
new ones (source_size, target, copies, taken) gives way to it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millwatch.llm.common import at, bare, given, written

#: With more sources than this their table is joined by a shuffle instead of a broadcast.
MOST_BROADCAST = 1 << 16
WEIGHTS = (5.0, 2.0, 1.0)
#: Documents that one task orders; a bin with more is cut again.
MOST_ORDERED = 1 << 20
NEW = ("source_size", "target", "copies", "taken")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = 3.0) -> DataFrame:
    """(source, source_size) -> with target. One row per source; weights repeat over the sources by code point, null last."""
    byte_order = W.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(byte_order) - 1, F.lit(len(weights))) + 1).cast("int"))
    one = sizes.withColumn("_w", w).withColumn("_cap", most * F.col("source_size"))
    up = W.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    before = up.rowsBetween(W.unboundedPreceding, -1)
    level = (F.sum("source_size").over(W.partitionBy()) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(up.rowsBetween(0, W.unboundedFollowing))
    one = one.withColumns({"_level": level, "_place": F.row_number().over(up)})
    # the first source, in this order, that is not cut sets the level for itself and all that follow
    first = F.min(F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.struct("_place", "_level"))).over(W.partitionBy())
    free = F.col("_place") >= first["_place"]
    return one.withColumn("target", F.when(free, F.least(first["_level"] * F.col("_w"), F.col("_cap"))).otherwise(F.col("_cap"))).select("source", "source_size", "target")


def uniform(key, seed: int):
    """A number in (0, 1) from the key's text: 52 bits of its md5."""
    return (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def length_appeal(size):
    """Longer documents are likelier, by the root of their size; whole numbers, so that sums don't depend on order."""
    return (F.floor(F.sqrt(size.cast("double"))) + 1).cast("double")


def mix(docs: DataFrame, id_col: str = "doc_id", size_col: str = "size", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, most: float = 3.0, appeal: str | None = None, seed: int = 11, bins: int = 4096) -> DataFrame:
    """docs with source_size long, target double, copies int (whole copies taken) and taken long (copies * size)."""
    if bins < 2 or bins & (bins - 1):
        raise ValueError("bins must be a power of two")  # so that a rank's bin is exact
    key, size, src = F.col(at(docs, id_col)), F.col(at(docs, size_col)), F.col(at(docs, source_col))
    a = F.coalesce(F.col(at(docs, appeal)).cast("double"), F.lit(0.0)) if appeal else F.lit(1.0)
    a = F.greatest(F.when(~F.isnan(a), a).otherwise(F.lit(0.0)), F.lit(1e-9))
    rows = bare(docs).withColumns({"_id": key.cast("string"), "_size": F.greatest(F.coalesce(size, F.lit(0)).cast("long"), F.lit(0)), "_src": src, "_u": uniform(key, seed), "_a": a})

    def ranked(r: DataFrame) -> DataFrame:
        """r with its source's figures and the document's place in the Pareto order."""
        r = r.join(few(targets), F.col("_src").eqNullSafe(F.col("_src2"))).drop("_src2")
        p = F.least(F.greatest(F.col("_a") * F.col("_rest") / F.col("_appeal"), F.lit(1e-12)), F.lit(1 - 1e-12))
        p = F.when(F.col("_appeal") > 0, p).otherwise(F.lit(0.5))
        return r.withColumn("_key", F.col("_u") / (1 - F.col("_u")) * (1 - p) / p)

    def share():
        """The rank, as a number in [0, 1) that keeps the order."""
        return F.col("_key") / (1 + F.col("_key"))

    slim = written(rows.select("_id", "_src", "_size", "_a", "_u"), "sizes")
    sums = slim.groupBy(F.col("_src").alias("source")).agg(F.sum("_size").alias("source_size"), F.sum(F.col("_size") * F.col("_a")).alias("_appeal"))
    targets = source_targets(sums.select("source", "source_size"), weights, most).join(sums.select(F.col("source").alias("_src2"), "_appeal"), F.col("source").eqNullSafe(F.col("_src2"))).drop("source")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    targets = targets.withColumn("_whole", whole).withColumn("_rest", F.col("target") - F.col("_whole") * F.col("source_size"))
    targets = written(targets, "targets")
    few = F.broadcast if targets.count() <= MOST_BROADCAST else (lambda x: x)
    # The bin of each source in which its target ends: all of the bins below it are taken, nothing above it. `_lo` and
    # `_step` say how the source's range is cut, `_before` counts the words below it.
    places = ranked(slim.where("_size > 0"))
    cut = targets.select(F.col("_src2").alias("_src3"), F.lit(0.0).alias("_lo"), F.lit(1.0 / bins).alias("_step"), F.lit(0).cast("long").alias("_before"), F.lit(False).alias("_over"))
    for _ in range(4):
        inside = places.join(few(cut), F.col("_src").eqNullSafe(F.col("_src3"))).withColumn("_bin", F.floor((share() - F.col("_lo")) / F.col("_step")))
        inside = inside.where((F.col("_bin") >= 0) & (F.col("_bin") < bins))
        per_bin = inside.groupBy("_src3", "_lo", "_step", "_bin").agg(F.sum("_size").alias("_n"), F.count("*").alias("_rows"), F.max("_rest").alias("_r"), F.max("_before").alias("_base"))
        before = F.col("_base") + F.coalesce(F.sum("_n").over(W.partitionBy("_src3").orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        ends = per_bin.withColumn("_at", before).where("_at <= _r and _at + _n > _r")
        cut = written(ends.select("_src3", (F.col("_lo") + F.col("_bin") * F.col("_step")).alias("_lo"), (F.col("_step") / bins).alias("_step"), F.col("_at").alias("_before"), (F.col("_rows") > MOST_ORDERED).alias("_over")), "cuts")
        if not cut.where("_over").take(1):
            break
    bin_of = F.floor((share() - F.col("_lo")) / (F.col("_step") * bins))
    within = places.join(few(cut), F.col("_src").eqNullSafe(F.col("_src3"))).where(bin_of == 0)
    run = F.col("_before") + F.coalesce(F.sum("_size").over(W.partitionBy("_src").orderBy("_key", "_id", "_size").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    last = within.withColumn("_run", run).where(2 * F.col("_run") + F.col("_size") <= 2 * F.col("_rest")).groupBy(F.col("_src").alias("_src4")).agg(F.max(F.struct("_key", "_id", "_size")).alias("_last"))
    cut = written(cut.join(last, F.col("_src3").eqNullSafe(F.col("_src4")), "left").drop("_src4", "_before", "_over"), "ends")
    out = ranked(rows).join(few(cut), F.col("_src").eqNullSafe(F.col("_src3")), "left")
    mine = F.struct("_key", "_id", "_size")
    extra = F.when(F.col("_lo").isNull() | (bin_of < 0), True).when(bin_of > 0, False).otherwise(F.coalesce(mine <= F.col("_last"), F.lit(False)))
    extra = extra & (F.col("_size") > 0) & (F.col("_rest") > 0) & (F.col("_whole") < most)
    out = out.withColumn("copies", F.col("_whole") + F.when(extra, 1).otherwise(0).cast("int"))
    return out.select(*given(docs, NEW), "source_size", "target", "copies", (F.col("copies") * F.col("_size")).alias("taken"))
