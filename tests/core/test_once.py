"""Operators that use their input several times make its rows once."""

import pytest
from pyspark.sql import functions as F

from millwatch.operators import encode, ordering, paths, runs
from millwatch.plans import datasets

TOKENS = lambda: encode.tokens_of("path_signature")


def baseline(df):
    d = df.withColumnsRenamed({"a": "L0_S1_F1", "b": "L0_S1_D1"})
    return datasets.baseline(d, ["L0_S1_F1"], ["L0_S1_D1"], 50)


CASES = {
    "pairs": (lambda d: paths.pair_cooccurrence(d), 5),
    "token rates": (lambda d: encode.oof_token_rates(d, "path_signature", TOKENS()), 5 * 3),
    "station duplicates": (lambda d: runs.station_duplicates(d, {"s": ["a"], "t": ["b"]}), 400),
    "baseline": (baseline, 400),
}


@pytest.mark.parametrize("name", CASES)
def test_once(spark, monkeypatch, name):
    monkeypatch.setattr(ordering, "ROWS", 50)
    seen = spark.sparkContext.accumulator(0)

    def told(i: int) -> str:
        seen.add(1)
        return ("A|B|C", "A", "B|C", "C|D|E", "__none__")[i % 5]

    sig = F.udf(told, "string")("Id")
    df = spark.range(400).select(F.col("id").alias("Id"), (F.col("id") % 3 == 0).cast("int").alias("Response"), sig.alias("path_signature"), (F.col("id") % 3).cast("int").alias("cv_fold"))
    df = df.withColumns({"a": (F.col("Id") % 17).cast("double") + F.length("path_signature"), "b": (F.col("Id") % 90).cast("double") + F.length("path_signature"), "start_time": (F.col("Id") * 7 % 100).cast("double")})
    make, rows = CASES[name]
    out = make(df).collect()
    assert len(out) == rows
    assert seen.value == 400
