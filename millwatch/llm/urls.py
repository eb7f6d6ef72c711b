"""URL filter: rules on host and path, and gradient-boosted trees on lexical features for what no rule fits.

Features of a URL's text: length, host length, path length, path depth, host labels, digit ratio, hyphens, letter
entropy of the host, number of query parameters, percent signs, and of its last host label ("suffix") the number of
labelled URLs and their smoothed block rate. The trees learn from labelled URLs.

URLs fall into three parts by a hash. A URL of one part is scored by trees that learned from the second, with suffix
statistics of the third, so neither its own label nor that of an equal URL has a share in its score. Fitting reads at
most `most_train` labelled rows a part, chosen by hash; suffix statistics cover all labelled rows.

Up to `MOST_RULES` rules stand in the plan; more are joined to the distinct hosts and paths by the host's endings.
Suffix statistics are broadcast up to `MOST_BROADCAST` rows, else joined with hot suffixes dealt over `SALT` tasks.

Defined results: a null URL or one without "://" has empty host and path, fits no rule and is scored on what is left
(zeros); very long URLs are read whole; repeated rows are judged alike, one row out for each row in; with no labelled
row, or labels of one kind only, the verdict without a rule is that kind's (allow, if there are none), and in a part
whose trees would see one kind only it is the suffix's rate; an empty table gives an empty result; a column of the
input named like one of the new ones (host, path, rule, verdict, score) gives way to it.
"""

from __future__ import annotations

import string

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millwatch.llm.common import at, bare, given, written

SPLIT = r"(?s)^.*?://([^/?#]*)([^?#]*)"
FEATURES = ("f_len", "f_host", "f_path", "f_depth", "f_labels", "f_digits", "f_hyphens", "f_entropy", "f_params", "f_percent", "f_suffix_n", "f_suffix_rate")
NEW = ("host", "path", "rule", "verdict", "score")
MOST_RULES, MOST_BROADCAST, SALT = 200, 1 << 16, 32
PARTS = 3


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, SPLIT, 1), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, SPLIT, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls. A rule is (verdict, "host/path")."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, r in sorted(rules, key=lambda x: (len(x[1]), x[1])):
        h, _, p = r.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        rule, verdict = F.when(fits, F.lit(r)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def _entropy(text: Column) -> Column:
    """Bits per character, of the characters that hosts are made of."""
    n = F.greatest(F.length(text), F.lit(1)).cast("double")
    total = F.lit(0.0)
    for c in string.ascii_lowercase + string.digits + "-.":
        p = (F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))) / n
        total = total - F.when(p > 0, p * F.log2(p)).otherwise(0.0)
    return total


def lexical(df: DataFrame, url: str, host: str, path: str) -> DataFrame:
    """df with the features that need no other row, and `_suffix`."""
    u, h, p = F.coalesce(F.col(url), F.lit("")), F.col(host), F.col(path)
    count = lambda c, pattern: F.regexp_count(c, F.lit(pattern)).cast("double")
    query = F.regexp_extract(u, r"(?s)\?([^#]*)", 1)
    return df.withColumns(
        {
            "f_len": F.length(u).cast("double"),
            "f_host": F.length(h).cast("double"),
            "f_path": F.length(p).cast("double"),
            "f_depth": count(p, "/[^/]"),
            "f_labels": count(h, r"[^.]+"),
            "f_digits": count(u, r"[0-9]") / F.greatest(F.length(u), F.lit(1)),
            "f_hyphens": count(h, "-"),
            "f_entropy": _entropy(h),
            "f_params": count(query, r"[^&]+"),
            "f_percent": count(u, "%"),
            "_suffix": F.element_at(F.split(h, r"\."), -1),
        }
    )


def with_rules(df: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """df (with host and path) with rule and _ruled."""
    if len(rules) <= MOST_RULES:
        rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
        return df.withColumns({"rule": rule, "_ruled": verdict})
    given_rules = df.sparkSession.createDataFrame([(r.partition("/")[0], "/" + r.partition("/")[2], r, v) for v, r in rules], "_h string, _p string, rule string, _v string")
    labels = F.split("host", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    pairs = df.select("host", "path").distinct().withColumn("_h", F.explode(ends)).join(given_rules, "_h").where(F.startswith(F.col("path"), F.col("_p")))
    best = pairs.groupBy("host", "path").agg(F.max(F.struct(F.length("rule").alias("n"), "rule", "_v")).alias("_r"))
    return df.join(best.select("host", "path", F.col("_r.rule").alias("rule"), F.col("_r._v").alias("_ruled")), ["host", "path"], "left")


def part_of(url: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(17), F.coalesce(url, F.lit(""))), F.lit(PARTS)).cast("int")


def suffix_statistics(labelled: DataFrame) -> DataFrame:
    """(_suffix, _part, f_suffix_n, f_suffix_rate): for the URLs of a part, over the labelled rows of another; the rate is
    drawn to that part's own by 20 rows."""
    per = labelled.groupBy("_part", "_suffix").agg(F.count("*").alias("n"), F.sum("label").alias("s"))
    all_of = labelled.groupBy("_part").agg(F.avg("label").alias("_all"))
    reader = F.pmod(F.col("_part") + 1, F.lit(PARTS)).cast("int")
    return per.join(F.broadcast(all_of), "_part").select("_suffix", reader.alias("_part"), F.log1p("n").alias("f_suffix_n"), ((F.col("s") + 20 * F.col("_all")) / (F.col("n") + 20)).alias("f_suffix_rate"))


def _with_suffix(df: DataFrame, suffixes: DataFrame, small: bool) -> DataFrame:
    if small:
        out = df.join(F.broadcast(suffixes), ["_suffix", "_part"], "left")
    else:
        dealt = suffixes.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        out = df.withColumn("_salt", F.pmod(F.xxhash64("_url"), F.lit(SALT)).cast("int")).join(dealt, ["_suffix", "_part", "_salt"], "left").drop("_salt")
    return out.fillna(0.0, ["f_suffix_n", "f_suffix_rate"])


def filter_urls(df: DataFrame, url: str, rules: list[tuple[str, str]], labelled: DataFrame, most_train: int = 20000, rounds: int = 8, depth: int = 4, seed: int = 7) -> DataFrame:
    """df with host, path, rule, verdict and score (the trees' probability of block).

    labelled: (url string, label double), 1 for block. Rows of df keep their other columns."""
    new = lambda d, u: lexical(d.withColumns({"_url": u, "host": host_of(u), "path": path_of(u), "_part": part_of(u)}), "_url", "host", "path")
    train = new(labelled.where("url is not null and label is not null").select("url", F.col("label").cast("double").alias("label")), F.col("url"))
    n, kinds, one = train.agg(F.count("*"), F.count_distinct("label"), F.max("label")).first()
    out = with_rules(new(bare(df), F.col(at(df, url))), rules)
    verdict = lambda score: F.coalesce("_ruled", F.when(score >= 0.5, "block").otherwise("allow"))
    if kinds < 2:
        score = F.lit(float(one or 0.0))
        return out.select(*given(df, NEW), "host", "path", "rule", verdict(score).alias("verdict"), score.alias("score"))
    suffixes = written(suffix_statistics(train), "suffixes")
    small = suffixes.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    some = train.where(F.pmod(F.xxhash64("url"), F.lit(1 << 30)) < int(min(1.0, PARTS * most_train / n) * (1 << 30)))
    vector = VectorAssembler(inputCols=list(FEATURES), outputCol="_x")
    # The rows of a part are read with the suffix statistics that the part they teach reads: those of the third.
    lessons = vector.transform(_with_suffix(some.withColumn("_part", F.pmod(F.col("_part") - 1, F.lit(PARTS)).cast("int")), suffixes, small))
    lessons = written(lessons.select("_x", "label", "_part"), "lessons")
    seen = {(r[0], r[1]) for r in lessons.select("_part", "label").distinct().collect()}
    rows = vector.transform(_with_suffix(out, suffixes, small))
    score = F.col("f_suffix_rate")
    for k in range(PARTS):
        if len({label for part, label in seen if part == k}) == 2:
            trees = GBTClassifier(featuresCol="_x", labelCol="label", maxIter=rounds, maxDepth=depth, stepSize=0.3, seed=seed, maxBins=32).fit(lessons.where(F.col("_part") == k))
            rows = trees.setRawPredictionCol(f"_raw{k}").setProbabilityCol(f"_prob{k}").setPredictionCol(f"_pred{k}").transform(rows)
            score = F.when(F.col("_part") == k, vector_to_array(f"_prob{k}")[1]).otherwise(score)
    rows = rows.withColumn("_score", score)
    return rows.select(*given(df, NEW), "host", "path", "rule", verdict(F.col("_score")).alias("verdict"), F.col("_score").alias("score"))
