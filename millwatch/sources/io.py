"""Reading and writing: CSV to Parquet, typed parts, tables of results, logs that may be written twice."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millwatch.functions.columns import StationCatalog


def raw_schema(names: list[str]) -> T.StructType:
    """All columns as text; optimize_types() gives them their types, so no file is read to infer a schema."""
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def csv_to_parquet(spark: SparkSession, source: str, target: str, names: list[str], overwrite: bool = False, whole: tuple[str, ...] = ()) -> None:
    """All CSV files below `source` as one typed Parquet table; an existing target stays unless overwrite. `whole`: columns
    of whole numbers, which get the narrowest type that holds them all (one more pass over these columns)."""
    rows = spark.read.schema(raw_schema(names)).option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").csv(source, header=True)
    kinds = narrowest(rows.select(*[F.col(c).try_cast("bigint").alias(c) for c in whole]), list(whole)) if whole else None
    optimize_types(rows, kinds).write.mode("overwrite" if overwrite else "ignore").parquet(target)


def optimize_types(df: DataFrame, whole: dict[str, str] | None = None) -> DataFrame:
    """Response: byte, 0 where it is none. Id: long. Measures and times: float. `whole`: columns of whole numbers with
    their types. Other columns stay."""
    catalog = StationCatalog.of(df.columns)
    floats = {*catalog.of_kind("F"), *catalog.of_kind("D")}
    out = []
    for c in df.columns:
        if c == "Response":
            out.append(F.coalesce(F.col(c).try_cast("double").try_cast("tinyint"), F.lit(0).cast("tinyint")).alias(c))
        elif c == "Id":
            out.append(F.col(c).try_cast("bigint").alias(c))
        elif c in floats:
            out.append(F.col(c).try_cast("float").alias(c))
        elif whole and c in whole:
            out.append(F.col(c).try_cast(whole[c]).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


def narrowest(df: DataFrame, cols: list[str]) -> dict[str, str]:
    """The smallest whole type that holds each column, from one aggregation."""
    ends = df.agg(*[f(F.col(c)).alias(f"{n}_{c}") for c in cols for n, f in (("lo", F.min), ("hi", F.max))]).first()
    kinds = (("tinyint", 7), ("smallint", 15), ("int", 31))
    out = {}
    for c in cols:
        lo, hi = ends[f"lo_{c}"] or 0, ends[f"hi_{c}"] or 0
        out[c] = next((k for k, b in kinds if -(1 << b) <= lo and hi < 1 << b), "bigint")
    return out


def read_tables(spark: SparkSession, folder: str, names: dict[str, str]) -> dict[str, DataFrame]:
    """CSV tables by name with their schemas (DDL); all missing ones are named in one error."""
    out, missing = {}, []
    for n, schema in names.items():
        try:
            df = spark.read.schema(schema).csv(f"{folder}/{n}", header=True)
            df.take(1)
            out[n] = df
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e) and "does not exist" not in str(e):
                raise
            missing.append(n)
    if missing:
        raise FileNotFoundError(f"missing tables in {folder}: {', '.join(missing)}")
    return out


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def write_summary(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def append_log(df: DataFrame, path: str, batch: str = "batch_id") -> None:
    """Writes the rows' batches; a batch that is written again replaces itself."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(batch).parquet(path)


def upsert(old: DataFrame | None, new: DataFrame, key: str) -> DataFrame:
    """old without the keys of new, and new."""
    return new if old is None else old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


@contextmanager
def new_version(spark: SparkSession, path: str) -> Iterator[str]:
    """A new folder below path, to be filled by the caller; when that ends without an error, one row of the manifest
    (a single small file) names the folder. Readers go by the manifest, so they see the version before or this one, whole;
    older ones stay for those who still read them. Of writers that end together the later name counts."""
    folder = f"{path.rstrip('/')}/version-{uuid.uuid4().hex}"
    yield folder
    number = (_versions(spark, path) or [(0, "")])[-1][0] + 1
    spark.createDataFrame([(number, folder.rpartition("/")[2])], VERSIONS).coalesce(1).write.mode("append").json(f"{path.rstrip('/')}/manifest")


VERSIONS = "number long, folder string"


def _versions(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    try:
        rows = spark.read.schema(VERSIONS).json(f"{path.rstrip('/')}/manifest").orderBy(F.desc("number"), F.desc("folder")).limit(1).collect()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return []
    return [(r["number"], r["folder"]) for r in rows]


def last_version(spark: SparkSession, path: str) -> str:
    """The folder of the last whole version below path."""
    found = _versions(spark, path)
    if not found:
        raise FileNotFoundError(f"no whole version in {path}")
    return f"{path.rstrip('/')}/{found[-1][1]}"


def update_summary(new: DataFrame, path: str, key: str) -> DataFrame:
    """new's rows in place of those with the same keys in the summary at path, which may not be there yet; gives the new
    summary. A writer that stops midway leaves the old one."""
    spark = new.sparkSession
    old = spark.read.parquet(last_version(spark, path)) if _versions(spark, path) else None
    with new_version(spark, path) as folder:
        upsert(old, new, key).coalesce(1).write.parquet(folder)
    return spark.read.parquet(last_version(spark, path))


#: Stored tables that lie in folders by columns, and these.
_BY: WeakKeyDictionary[DataFrame, list[str]] = WeakKeyDictionary()


def stored_by(df: DataFrame) -> list[str] | None:
    """The columns by which df, a table that stored() gave, lies in folders."""
    return _BY.get(df)


def stored(df: DataFrame, name: str = "t", by: list[str] | None = None) -> DataFrame:
    """df written as Parquet below spark.checkpoint.dir, in a folder for the application (which may be removed when that
    has ended), and read again: later steps neither repeat its work nor carry its plan. Where the setting is unset, a
    temporary folder serves, but only if driver and executors are one process. by: columns of few values, a folder each, so
    that a filter on them reads no other rows."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.gettempdir()
    path = f"{base.rstrip('/')}/millwatch-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}/{name}"
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    if by:
        out = out.select(*[F.col(f"`{c}`") for c in df.columns])
        _BY[out] = by
    return out
