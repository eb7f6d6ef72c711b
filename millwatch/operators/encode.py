"""Target statistics: encodings, fitted scalars, out-of-fold rates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millwatch.operators import select
from millwatch.operators.ordering import meet_groups
from millwatch.operators.paths import parse
from millwatch.sources.io import stored


def target_encoding(df: DataFrame, cols: list[str], target: str = "Response") -> DataFrame:
    """(col, value, rate): mean target of each value of each column, in one aggregation over the unpivoted columns."""
    long = df.select(target, F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).cast("string").alias("value")) for c in cols])).alias("p")).select(target, "p.*")
    return long.where("value is not null").groupBy("col", "value").agg(F.avg(target).alias("rate"))


#: Values of a column whose rates are one map, and of all such columns together; a column with more meets its values in
#: the one join that all such columns share.
MAP_VALUES, MOST_MAPPED = 32, 1 << 16


def apply_encoding(df: DataFrame, table: DataFrame, cols: list[str], default: DataFrame, suffix: str = "_target_enc", row_id: str = "Id") -> DataFrame:
    """df with each column's encoding; null, unseen and absent values get the default. Columns with few values take them
    from maps in one broadcast row of bounded size. The others are unpivoted, without their nulls, meet all their rates
    in one join that sets heavy values apart, and come back as one map a row (row_id tells rows apart; without a column
    of that name a row's own hash does)."""
    sizes = {r["col"]: r["count"] for r in table.groupBy("col").count().collect()}  # a row a column
    known = [c for c in cols if c in df.columns and sizes.get(c)]
    small, held = [], 0
    for c in sorted(known, key=lambda c: sizes[c]):
        if sizes[c] <= MAP_VALUES and held + sizes[c] <= MOST_MAPPED:
            small.append(c)
            held += sizes[c]
    large = [c for c in known if c not in set(small)]
    out = df.crossJoin(F.broadcast(default.select(F.col(default.columns[0]).alias("_g"))))
    found: dict[str, Column] = {}
    if small:
        per = table.where(F.col("col").isin(small)).groupBy("col").agg(F.map_from_entries(F.collect_list(F.struct("value", "rate"))).alias("m"))
        maps = per.groupBy().agg(*[F.first(F.when(F.col("col") == c, F.col("m")), ignorenulls=True).alias(f"_m{i}") for i, c in enumerate(small)])
        out = out.crossJoin(F.broadcast(maps))
        found |= {c: F.when(F.col(c).isNotNull(), F.try_element_at(F.col(f"_m{i}"), F.col(c).cast("string"))) for i, c in enumerate(small)}
    if large:
        out = out.withColumn("_row", F.col(row_id) if row_id in df.columns else F.sha2(F.to_json(F.struct(*df.columns)), 256))
        # a value of a column as one key; nulls leave before anything is shuffled
        each = out.select("_row", F.explode(F.filter(F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).cast("string").alias("value")) for c in large]), lambda p: p["value"].isNotNull())).alias("p")).select("_row", "p.*")
        rated = meet_groups(each, table.where(F.col("col").isin(large)), ["col", "value"]).where("rate is not null")
        back = rated.groupBy("_row").agg(F.map_from_entries(F.collect_set(F.struct("col", "rate"))).alias("_e"))
        out = out.join(back, "_row", "left").drop("_row")
        found |= {c: F.try_element_at(F.col("_e"), F.lit(c)) for c in large}
    out = out.withColumns({f"{c}{suffix}": F.coalesce(found.get(c, F.lit(None).cast("double")), F.col("_g")) for c in cols})
    return out.drop("_g", "_e", *[f"_m{i}" for i in range(len(small))])


def percentiles(df: DataFrame, cols: list[str], shares: list[float], at_hand: bool = False) -> DataFrame:
    """(col, share, value): exact percentiles, between two values by their distance; a column without values has no
    row. All columns' ranks are found together by nested histograms, so neither rows nor values are ordered. Of many columns
    one pass tells those with few values first, whole. The columns are stored first, as each pass reads them, unless they
    are at hand (columns of a stored table)."""
    slim = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    slim = slim if at_hand else stored(slim, "columns")
    ends = lambda m: {(q, end): end(q * (m - 1)) for q in map(float, shares) for end in (math.floor, math.ceil)}
    names = [f"c{i}" for i in range(len(cols))]
    many = len(cols) > select.FEW_COLUMNS
    told = dict(zip(names, select.profiles(slim, names), strict=True)) if many else {}
    left = [c for c in names if c not in told or not told[c].exact]
    found = select.places(slim, left, lambda m: ends(m) | {"last": m - 1}, arrays=many) if left else {}
    rows = []
    for i, c in enumerate(cols):
        if names[i] not in left:
            p = told[names[i]]
            rows += [(c, q, p.at(q)) for q in map(float, shares)] if len(p.values) else []
            continue
        if (f"c{i}", "last") not in found:
            continue
        last = found[f"c{i}", "last"]
        m = last.below + last.equal
        for q in map(float, shares):
            x, y, f = found[f"c{i}", (q, math.floor)].value, found[f"c{i}", (q, math.ceil)].value, q * (m - 1) - math.floor(q * (m - 1))
            rows.append((c, q, x if x == y else x * (1 - f) + y * f))
    return df.sparkSession.createDataFrame(rows, "col string, share double, value double")  # a row a column and share


def scalars(df: DataFrame, col: str, exact: bool = True, at_hand: bool = False) -> DataFrame:
    """One row: mean, std (sample; 1 where it is not positive), p90, p10. The approximate percentiles need one pass."""
    sd = F.stddev_samp(col)
    one = df.agg(F.avg(col).alias("mean"), F.when(sd > 0, sd).otherwise(1.0).alias("std"), *([] if exact else [F.approx_percentile(col, F.lit(q), F.lit(10000)).cast("double").alias(n) for q, n in ((0.9, "p90"), (0.1, "p10"))]))
    if exact:
        at = lambda q: F.max(F.when(F.col("share") == q, F.col("value")))
        one = one.crossJoin(percentiles(df, [col], [0.9, 0.1], at_hand).agg(at(0.9).alias("p90"), at(0.1).alias("p10")))
    return one


def medians(df: DataFrame, cols: list[str], exact: bool = True, at_hand: bool = False) -> DataFrame:
    """(col, median): 0 for a column without values."""
    if exact:
        names = df.sparkSession.createDataFrame([(c,) for c in cols], "col string")
        return names.join(F.broadcast(percentiles(df, cols, [0.5], at_hand)), "col", "left").select("col", F.coalesce("value", F.lit(0.0)).alias("median"))
    one = df.agg(*[F.coalesce(F.approx_percentile(c, F.lit(0.5), F.lit(10000)).cast("double"), F.lit(0.0)).alias(c) for c in cols])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).alias("median")) for c in cols])).alias("p")).select("p.*")


def oof_rate(df: DataFrame, key: str, fold: str = "cv_fold", target: str = "Response", out: str = "oof_rate") -> DataFrame:
    """df with the key's target rate in the other folds; the overall mean where they don't have it. A key's total less
    its share of the fold, so no loop over folds."""
    per = df.groupBy(F.col(key).alias("_k"), F.col(fold).alias("_f")).agg(F.sum(target).alias("_s"), F.count(target).alias("_n"))
    w = W.partitionBy("_k")
    rate = F.try_divide(F.sum("_s").over(w) - F.col("_s"), (F.sum("_n").over(w) - F.col("_n")).cast("double"))
    per = per.select("_k", "_f", rate.alias("_r"))
    mean = df.agg(F.avg(target).alias("_g"))
    j = df.join(per, df[key].eqNullSafe(per["_k"]) & df[fold].eqNullSafe(per["_f"]), "left")
    return j.crossJoin(F.broadcast(mean)).withColumn(out, F.coalesce("_r", "_g")).drop("_k", "_f", "_r", "_g")


def oof_token_rates(df: DataFrame, sig: str, tokens: Column, fold: str = "cv_fold", target: str = "Response") -> DataFrame:
    """(token, fold, rate) from the other folds: sums by signature and fold (stored, so that no row makes its tokens), then
    by their tokens."""
    per = stored(df.groupBy(sig, fold).agg(F.sum(target).alias("s"), F.count(target).alias("n")), "signatures")
    each = per.select(fold, "s", "n", F.explode(tokens).alias("token")).groupBy("token", fold).agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    folds = per.select(fold).distinct()
    grid = each.select("token").distinct().crossJoin(F.broadcast(folds)).join(each, ["token", fold], "left").fillna(0, ["s", "n"])
    w = W.partitionBy("token")
    rate = F.try_divide(F.sum("s").over(w) - F.col("s"), (F.sum("n").over(w) - F.col("n")).cast("double"))
    return grid.select("token", fold, rate.alias("rate"))


def signature_token_stats(df: DataFrame, sig: str, tokens: Column, rates: DataFrame, names: tuple[str, str, str], fold: str = "cv_fold", target: str = "Response") -> DataFrame:
    """(signature, fold) with mean, max and deviation of its tokens' rates; an unseen token counts as the overall mean,
    a signature without tokens has (mean, mean, 0)."""
    mean = df.agg(F.avg(target).alias("_g"))
    per = stored(df.select(sig, fold).distinct(), "signatures").withColumn("_t", tokens).crossJoin(F.broadcast(mean))
    each = per.select(sig, fold, "_g", F.explode("_t").alias("token")).join(rates, ["token", fold], "left")
    r = F.coalesce("rate", "_g")
    stats = each.groupBy(F.col(sig).alias("_s"), F.col(fold).alias("_f")).agg(F.avg(r).alias("a"), F.max(r).alias("b"), F.stddev_pop(r).alias("c"))
    out = per.join(stats, per[sig].eqNullSafe(stats["_s"]) & per[fold].eqNullSafe(stats["_f"]), "left")
    return out.select(sig, fold, F.coalesce("a", "_g").alias(names[0]), F.coalesce("b", "_g").alias(names[1]), F.coalesce("c", F.lit(0.0)).alias(names[2]))


def uniqueness_gate(df: DataFrame, cols: list[str], least: float = 0.01, digits: int = 6) -> DataFrame:
    """One row: valid rows, distinct rounded values, and whether their ratio reaches `least`."""
    key = F.struct(*[F.bround(F.col(c), digits).alias(c) for c in cols])
    has = F.coalesce(*[F.col(c) for c in cols]).isNotNull()
    per = df.where(has).groupBy(key.alias("k")).agg(F.count("*").alias("n"))
    one = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("valid"), F.count("*").alias("distinct_values"))
    return one.withColumn("use_counts", F.coalesce(F.try_divide(F.col("distinct_values").cast("double"), F.col("valid").cast("double")) >= least, F.lit(False)))


def tokens_of(sig: str) -> Column:
    return parse(F.col(sig))
