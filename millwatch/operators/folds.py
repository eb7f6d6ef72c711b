"""Stratified folds that keep groups whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millwatch.operators.ordering import running
from millwatch.sources.io import stored


#: A group of more than so many times the mean weight is dealt by itself; so many at most.
HEAVY_TIMES, MOST_HEAVY = 4, 4096


def group_folds(df: DataFrame, group: str, target: str = "Response", folds: int = 5, seed: int = 42) -> DataFrame:
    """(group, cv_fold). A group weighs its share of the rows and of the positives. Heavy groups, a bounded number, go one
    by one to the lightest fold, heaviest first. The others, in order of positives, rows and a hash of name and seed, first
    fill the folds up to the fullest (by running weight) and then go to folds in a serpentine. So folds differ by the
    heaviest group's weight at most, and by one light group where none is heavy."""
    stats = stored(df.groupBy(group).agg(F.sum(target).alias("_p"), F.count("*").alias("_n")), "groups")
    one = stats.agg(F.count("*").alias("k"), F.sum("_n").alias("n"), F.sum("_p").alias("p")).first()
    if one["k"] < folds:
        raise ValueError(f"fewer groups than {folds} folds")
    weight = F.col("_n") / F.lit(one["n"]) + (F.col("_p") / F.lit(one["p"]) if one["p"] else F.lit(0.0))
    name = F.md5(F.concat(F.col(group).cast("string"), F.lit(f":{seed}")))
    stats = stats.withColumns({"_w": weight, "_h": name})
    limit = HEAVY_TIMES * (2 if one["p"] else 1) / one["k"]
    heavy = stats.where(F.col("_w") > limit).orderBy(F.desc("_w"), "_h").limit(MOST_HEAVY).select(group, "_w").collect()  # MOST_HEAVY rows at most
    load, mine = [0.0] * folds, []
    for r in heavy:
        f = min(range(folds), key=lambda k: load[k])
        load[f] += r["_w"]
        mine.append((r[group], f))
    placed = stats.sparkSession.createDataFrame(mine, f"`{group}` {stats.schema[group].dataType.simpleString()}, cv_fold int")
    light = stats.join(F.broadcast(placed.select(F.col(group).alias("_g"))), F.col(group).eqNullSafe(F.col("_g")), "left_anti") if mine else stats
    # up to the fullest fold: (fold, running weight at which it is full)
    upto, edges = 0.0, []
    for f in sorted(range(folds), key=lambda k: load[k]):
        upto += max(load) - load[f]
        edges.append((f, upto))
    line = running(light, [F.desc("_p"), F.desc("_n"), F.col("_h").asc(), F.col(group).asc()], {"_r": F.lit(1).cast("long"), "_s": F.col("_w")}, inclusive=False)
    filling = F.coalesce(F.col("_s"), F.lit(0.0)) < upto * (1 - 1e-12) if mine else F.lit(False)
    fill = F.coalesce(*[F.when(F.col("_s") < edge, f) for f, edge in edges], F.lit(edges[-1][0]))
    skipped = stored(line, "line").where(filling).count() if mine else 0
    r = F.pmod(F.col("_r") - skipped, F.lit(2 * folds))
    fold = F.when(filling, fill).otherwise(F.when(r < folds, r).otherwise(2 * folds - 1 - r)).cast("int")
    out = line.select(group, fold.alias("cv_fold"))
    return out.unionByName(placed) if mine else out


def assign_folds(df: DataFrame, table: DataFrame, group: str, check: bool = True) -> DataFrame:
    """df with cv_fold; with check, an action that raises if a row has none."""
    out = df.join(table, group, "left")
    if check and out.where("cv_fold is null").take(1):
        raise ValueError("a row has no fold")
    return out


def group_overlap(df: DataFrame, group: str, fold: str = "cv_fold") -> DataFrame:
    """Groups that stand in more than one fold."""
    return df.groupBy(group).agg(F.count_distinct(fold).alias("folds")).where("folds > 1")
