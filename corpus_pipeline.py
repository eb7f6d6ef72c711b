"""A corpus from raw documents to shards, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's rows as Parquet in the
shared folder and reads them for the next. All but the last stage return the columns of documents, whatever they are:
a stage needs doc_id, text and source, and works on columns of its own names, so that extra ones never clash. Rows are
told apart by a key of id and text, so that a null or repeated doc_id neither keeps nor drops another row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millwatch.llm import decontaminate, jaccard, langid, mixing, sharding
from millwatch.llm.common import at, bare, word_count, written
from millwatch.llm.queries import SHARDS, SLOTS, table


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with columns in0, in1, ... and key long, id long, text."""
    doc_id, text = F.col(at(docs, "doc_id")), F.col(at(docs, "text"))
    key = F.xxhash64(F.coalesce(doc_id.cast("string"), F.lit("\0")), F.coalesce(text, F.lit("\0")))
    return bare(docs).withColumns({"key": key, "id": doc_id.cast("long"), "text": text})


def _back(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*[f"in{i}" for i in range(len(docs.columns))]).toDF(*docs.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what language identification rejects: text without a letter (null and empty texts are), or unlike every
    language it learned from the rows with a lang that aren't held out. Repeated rows are judged alike; without a
    labelled row all rows go; an empty table gives an empty one."""
    rows = _keyed(docs)
    lang = F.col(at(docs, "lang"))
    train = rows.where(~langid.held_out(F.col("id"))).select(F.col("id").cast("string").alias("key"), "text", lang.alias("lang"))
    return _back(langid.identify(rows, langid.fit(train), out=("lang_pred", "score", "rejected")).where(~F.col("rejected")), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near copies (five words, 0.8): the one with the smallest id, a null id last.
    Of rows equal in id and text one stays. Null and empty texts have no shingles and stay; an empty table gives an empty one."""
    rows = _keyed(docs)
    classes = jaccard.link_classes(rows, doc_id="key", text="text")
    ids = rows.select(F.col("key").alias("doc_id"), "id")
    named = written(classes.join(ids, "doc_id").select(F.col("component_id").alias("c"), F.struct(F.col("id").isNull().alias("z"), "id", F.col("doc_id").alias("key")).alias("who")), "named")
    best = named.groupBy("c").agg(F.min("who").alias("best"))
    gone = named.select("who.key").distinct().join(best.select("best.key"), "key", "left_anti")
    kept = rows.join(gone, "key", "left_anti")
    twice = written(rows.groupBy("key").count().where("count > 1").select("key"), "twice")
    if twice.take(1):
        kept = kept.join(twice, "key", "left_anti").unionByName(kept.join(twice, "key", "left_semi").dropDuplicates(["key"]))
    return _back(kept, docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item. Null and empty texts hold none; repeated rows go or stay together; with
    an empty benchmark all stay; an empty table gives an empty one."""
    rows = _keyed(docs)
    found = decontaminate.find_contamination(rows, table(spark, sf_dir, "benchmark"), doc_id="key").select(F.col("doc_id").alias("key")).distinct()
    return _back(rows.join(found, "key", "left_anti"), docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as the mix of sources says: 0 to 3 times; longer ones are likelier. Null and empty
    texts have size 0 and come as often as their source's certain copies; equal rows are taken as rows of their own; an
    empty table gives an empty one."""
    size = word_count(F.col("text"))
    rows = _keyed(docs).withColumns({"size": size, "appeal": mixing.length_appeal(size), "source": F.col(at(docs, "source"))})
    out = mixing.mix(rows.drop("text", "id"), id_col="key", appeal="appeal")
    return _back(out.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))), docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds slot and shard, by doc_id; rows without one are placed by their other columns."""
    return sharding.assign_shards(docs, ["doc_id"], SHARDS, SLOTS)


STAGES = [("language_id", language), ("ngram_jaccard", near_duplicates), ("decontamination", decontaminated), ("mixing", mixed), ("sharding", sharded)]

#: Language models and connected near copies are beyond SQL; the pipeline is tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
