"""Licence scan: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

A text's lines are compared with licence templates. A term's weight is its count times idf = 1 + ln((1 + N) / (1 + n)),
N being all documents and n those with the term; terms of no template count as n = 0. A line whose cosine to a template
reaches `least` carries that licence. A file whose name says so (license, licence, copying, notice) or of whose terms
`share` stand in such lines is a licence file and speaks for its directory. A file without a licence of its own takes
that of the nearest directory above it that has one.

Besides, lines, paragraphs, blocks between blank lines and whole texts are compared with the common licences of
license_texts.py: one-line headers, header notices, also wrapped over lines, and full texts. There idf is taken over
those templates, N being their number, so it needs no second look at all files; a unit must also have all of the
template's key words (a name, a version). An SPDX-License-Identifier line states its licences with score 1. Given
`templates` of one's own, only lines are compared with them. The highest cosine of all of these is the file's.

Lines that can't reach `least` are dropped before their terms are counted: from the weights follow, for each template,
terms without which no line can (the cosine is at most the norm of the template's terms that the line has, over the
template's norm). All lines of whole texts are judged.

DataFrame functions only. Weights and templates are bounded by the templates given; directories meet in joins by
path after each directory was made one row.

Defined results: null and empty texts have no licence of their own; a null path has no directory and inherits
nothing; several licences in a file: the highest cosine, then the first name; several licence files in a directory
likewise; repeated rows are judged once and alike, one row out for each row in; very long texts are judged whole; an empty
table gives an empty result; a column of the input named like one of the new ones gives way to it. GNU notices without a version have no licence.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millwatch.llm import license_texts
from millwatch.llm.common import at, bare, given, meet_groups, written

#: Licence texts as headers state them.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
}
SPLIT = r"[^\p{L}\p{N}]+"
#: Between paragraphs stand lines without letters and digits, between blocks blank ones.
PARAGRAPHS, BLOCKS = r"(?:\n[^\p{L}\p{N}\n]*)+\n", r"\n[ \t\r]*\n"
SPDX = r"(?i)SPDX-License-Identifier:[ \t]*(\(*[A-Za-z0-9][A-Za-z0-9.+-]*\)*(?:[ \t]+(?:AND|OR|WITH)[ \t]+\(*[A-Za-z0-9][A-Za-z0-9.+-]*\)*)*)"
#: Directories that inherit are broadcast up to so many.
MOST_BROADCAST = 1 << 16
NEW = ("own_license", "own_score", "license", "license_dir", "is_license_file")
NAMES = r"(?i)(^|/)(licen[sc]e|copying|notice)[^/]*$"


def terms(text: str) -> list[str]:
    return [t for t in re.split(r"[\W_]+", text.lower()) if t]


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), SPLIT), lambda t: t != "")


def template_weights(templates: dict[str, str], n: int, df: dict[str, int]) -> tuple[dict[str, dict[str, float]], dict[str, float]]:
    """({template: {term: weight}} with norm 1, {term: idf})."""
    idf = {t: 1 + math.log((1 + n) / (1 + df.get(t, 0))) for text in templates.values() for t in terms(text)}
    out = {}
    for name, text in sorted(templates.items()):
        w: dict[str, float] = {}
        for t in terms(text):
            w[t] = w.get(t, 0.0) + idf[t]
        norm = math.sqrt(sum(x * x for x in w.values()))
        out[name] = {t: x / norm for t, x in w.items()}
    return out, idf


def signals(weights: dict[str, dict[str, float]], least: float) -> list[str]:
    """Terms of which a line must have one to reach `least` with any template."""
    need: set[str] = set()
    for w in weights.values():
        mass = 0.0
        for t, x in sorted(w.items(), key=lambda kv: (kv[1], kv[0])):
            mass += x * x
            if math.sqrt(mass) >= least - 1e-9:
                need.add(t)
    return sorted(need)


def spelled(text: Column) -> Column:
    """Lower case, one spelling of license, and v3 as v 3."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "licence", "license"), r"\bv(?=\d)", "v ")


def scan_common(keyed: DataFrame, least: float) -> DataFrame:
    """(_id, _h, b, _said) of the texts that carry a common licence: b as struct(-cosine, licence), and the terms of
    the largest unit that does."""
    spark = keyed.sparkSession
    same = lambda t: re.sub(r"\bv(?=\d)", "v ", t.lower().replace("licence", "license"))
    given = license_texts.common()
    texts = {f"{i:03d}": same(text) for i, (_, _, text) in enumerate(given)}
    keys = {k: sorted(set(words.split())) for k, (_, words, _) in zip(texts, given, strict=True)}
    licence = {k: name for k, (name, _, _) in zip(texts, given, strict=True)}
    n = len(texts)
    df: dict[str, int] = {}
    for text in texts.values():
        for t in set(terms(text)):
            df[t] = df.get(t, 0) + 1
    weights, idf = template_weights(texts, n, df)
    rows: dict[str, list] = {t: [] for t in idf}
    for k, w in weights.items():
        for t, x in w.items():
            rows[t].append((k, float(x), int(t in keys[k])))
    table = spark.createDataFrame([(t, float(idf[t]), w) for t, w in sorted(rows.items())], "t string, idf double, w array<struct<name:string,x:double,k:int>>")
    told = spark.createDataFrame([(k, licence[k], len(keys[k])) for k in texts], "name string, licence string, _keys int")
    sets: dict[tuple, list] = {}
    for k in texts:
        sets.setdefault(tuple(keys[k]), []).append(k)
    # units with the key words of a template, and which those are
    first = sorted({words.split()[0] for _, words, _ in given})
    quick = "(?i)" + "|".join(first).replace("license", "licen[sc]e")
    may = F.flatten(F.array(*[F.when(_all([F.contains(F.col("_l"), F.lit(w)) for w in words]), F.array(*[F.lit(k) for k in ks])).otherwise(F.array().cast("array<string>")) for words, ks in sets.items()]))
    body = F.col("_text")
    units = F.array_distinct(F.concat(F.array(body), F.split(body, BLOCKS), F.split(body, PARAGRAPHS), F.split(body, r"\n")))
    by = ["_id", "_h", "_unit"]
    units = keyed.where(body.rlike(quick)).select("_id", "_h", F.posexplode(F.filter(units, lambda u: u.rlike(quick))).alias("_unit", "_l")).withColumn("_l", spelled(F.col("_l")))
    units = units.withColumn("_may", may).where(F.size("_may") > 0).dropDuplicates(by)  # a repeated row counts once
    counts = units.select(*by, "_may", F.explode(tokens(F.col("_l"))).alias("t")).groupBy(*by, "_may", "t").agg(F.count("*").alias("c"))
    weighed = counts.join(F.broadcast(table), "t", "left").withColumn("v", F.col("c") * F.coalesce("idf", F.lit(1 + math.log(1 + n))))
    weighed = weighed.select(*by, "v", "c", F.filter(F.coalesce("w", F.array().cast("array<struct<name:string,x:double,k:int>>")), lambda w: F.array_contains("_may", w["name"])).alias("w"))
    norms = weighed.groupBy(*by).agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("_norm"), F.sum("c").alias("_n"), F.collect_list(F.when(F.size("w") > 0, F.struct("v", "w"))).alias("_hits"))
    dots = norms.select(*by, "_norm", "_n", F.explode("_hits").alias("h")).select(*by, "_norm", "_n", "h.v", F.explode("h.w").alias("w")).groupBy(*by, "_norm", "_n", F.col("w.name").alias("name")).agg(F.sum(F.col("v") * F.col("w.x")).alias("_dot"), F.sum("w.k").alias("_k"))
    hits = dots.join(F.broadcast(told), "name").withColumn("score", F.col("_dot") / F.col("_norm")).where((F.col("score") >= least) & (F.col("_k") == F.col("_keys")))
    found = hits.select("_id", "_h", F.struct((-F.round("score", 9)).alias("s"), F.col("licence").alias("name")).alias("b"), F.col("_n").alias("_said"))
    # what SPDX lines state
    stated = keyed.where(body.contains("SPDX-License-Identifier:") | body.rlike("(?i)spdx-license-identifier:")).select("_id", "_h", F.explode(F.regexp_extract_all("_text", F.lit(SPDX), 1)).alias("e"))
    stated = stated.select("_id", "_h", F.explode(F.split(F.regexp_replace("e", r"(?i)[ \t]+WITH[ \t]+[^ \t)]+", ""), r"(?i)[ \t]+(?:AND|OR)[ \t]+")).alias("e"))
    name = F.regexp_replace(F.regexp_replace("e", r"[()]|\.+$", ""), r"(?i)(-only|-or-later|\+)$", "")
    stated = stated.select("_id", "_h", F.struct(F.lit(-1.0).alias("s"), name.alias("name")).alias("b"), (3 + F.size(tokens(name))).cast("long").alias("_said"))
    return found.unionByName(stated).groupBy("_id", "_h").agg(F.min("b").alias("b"), F.max("_said").alias("_said"))


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def scan_licenses(files: DataFrame, key: str = "id", path: str = "path", text: str = "text", templates: dict[str, str] | None = None, least: float = 0.7, share: float = 0.5) -> DataFrame:
    """files without the text, with own_license, own_score, license, license_dir (null where it is the file's own)
    and is_license_file."""
    both, templates = templates is None, TEMPLATES if templates is None else templates
    base, key, body, p = [*NEW, text], at(files, key), F.col(at(files, text)), F.col(at(files, path))
    kept, spark, text_col, files = given(files, base), files.sparkSession, at(files, text), bare(files)
    vocabulary = sorted({t for x in templates.values() for t in terms(x)})
    found = files.select(F.explode(F.concat(F.array(F.lit("")), F.array_intersect(tokens(F.coalesce(body, F.lit(""))), F.array(*[F.lit(t) for t in vocabulary])))).alias("t")).groupBy("t").count()
    df = {r["t"]: r["count"] for r in found.collect()}  # a row a template term, and one for all documents
    n = df.pop("", 0)
    weights, idf = template_weights(templates, n, df)
    unseen = 1 + math.log(1 + n)
    table = spark.createDataFrame([(t, float(idf[t]), [(name, float(w[t])) for name, w in weights.items() if t in w]) for t in vocabulary], "t string, idf double, w array<struct<name:string,x:double>>")
    needs = signals(weights, least)
    has = lambda c: F.arrays_overlap(tokens(c), F.array(*[F.lit(t) for t in needs]))
    quick = "(?i)" + "|".join(re.escape(t) for t in needs) if needs else "$^"
    # lines that can carry a licence
    keyed = files.select(F.col(key).alias("_id"), F.xxhash64(body).alias("_h"), body.alias("_text"))
    lines = keyed.where(F.lower("_text").rlike(quick)).select("_id", "_h", F.posexplode(F.split("_text", r"\n")).alias("_line", "_l")).where(F.lower("_l").rlike(quick)).where(has(F.col("_l")))
    lines = lines.dropDuplicates(["_id", "_h", "_line"])  # a repeated row counts once
    counts = lines.select("_id", "_h", "_line", F.explode(tokens(F.col("_l"))).alias("t")).groupBy("_id", "_h", "_line", "t").agg(F.count("*").alias("c"))
    weighed = counts.join(F.broadcast(table), "t", "left").withColumn("v", F.col("c") * F.coalesce("idf", F.lit(unseen)))
    by = ["_id", "_h", "_line"]
    per_term = weighed.select(*by, "v", "c", F.coalesce("w", F.array().cast("array<struct<name:string,x:double>>")).alias("w"))
    norms = per_term.groupBy(*by).agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("_norm"), F.sum("c").alias("_n"), F.collect_list(F.when(F.size("w") > 0, F.struct("v", "w"))).alias("_hits"))
    dots = norms.select(*by, "_norm", "_n", F.explode("_hits").alias("h")).select(*by, "_norm", "_n", "h.v", F.explode("h.w").alias("w")).groupBy(*by, "_norm", "_n", F.col("w.name").alias("name")).agg(F.sum(F.col("v") * F.col("w.x")).alias("_dot"))
    hits = dots.withColumn("score", F.col("_dot") / F.col("_norm")).where(F.col("score") >= least)
    best = F.min(F.struct((-F.round("score", 9)).alias("s"), "name"))
    line = hits.groupBy(*by, "_n").agg(best.alias("b"))
    own = line.groupBy("_id", "_h").agg(F.min("b").alias("b"), F.sum("_n").alias("_said"))
    if both:
        own = own.unionByName(scan_common(keyed, least)).groupBy("_id", "_h").agg(F.min("b").alias("b"), F.max("_said").alias("_said"))
    own = written(own, "own")
    # each file, with what its own text says
    base = [c for c in files.columns if c != text_col]
    rows = files.select(*base, F.col(key).alias("_i"), F.xxhash64(body).alias("_x"), F.regexp_count(F.coalesce(body, F.lit("")), F.lit(r"[\p{L}\p{N}]+")).alias("_all"), p.alias("_path"))
    rows = rows.join(own, F.col("_i").eqNullSafe(F.col("_id")) & (F.col("_x") == F.col("_h")), "left")
    said = F.col("_said") / F.greatest(F.col("_all"), F.lit(1))
    p = F.col("_path")
    rows = rows.select(*base, F.col("b.name").alias("own_license"), (-F.col("b.s")).alias("own_score"), (F.col("b").isNotNull() & ((said >= share) | F.coalesce(p.rlike(NAMES), F.lit(False)))).alias("is_license_file"), F.regexp_extract(p, r"(?s)^(.*)/[^/]*$", 1).alias("_dir"))
    rows = written(rows, "files")
    # directories: what they say, and the nearest that says something
    speak = rows.where("is_license_file and _dir is not null").groupBy(F.col("_dir").alias("_at")).agg(F.min(F.struct((-F.col("own_score")).alias("s"), F.col("own_license").alias("name"))).alias("_b")).select("_at", F.col("_b.name").alias("_name"))
    dirs = rows.where("own_license is null and _dir is not null").groupBy("_dir").agg(F.count("*").alias("_rows"))
    parts = F.split("_dir", "/")
    above = dirs.select("_dir", "_rows", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, F.lit(1), k), "/").alias("at")))).alias("u")).select("_dir", "_rows", "u.depth", F.col("u.at").alias("_at"))
    near = above.join(speak, "_at").groupBy("_dir", "_rows").agg(F.max(F.struct("depth", F.col("_at").alias("at"), F.col("_name").alias("name"))).alias("_n")).select("_dir", "_rows", F.col("_n.at").alias("_from"), F.col("_n.name").alias("_license"))
    near = written(near, "near")
    if near.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:
        out = rows.join(F.broadcast(near.drop("_rows")), "_dir", "left")
    else:  # a directory may hold a third of all files
        out = meet_groups(rows, near, "_dir", "_rows")
    heir = F.col("own_license").isNull()
    return out.select(*kept, "own_license", "own_score", F.when(heir, F.col("_license")).otherwise(F.col("own_license")).alias("license"), F.when(heir, F.col("_from")).alias("license_dir"), "is_license_file")
