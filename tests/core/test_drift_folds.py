"""Tests of categories against tabulated values; folds of groups of very different sizes."""

import math
import random

import pytest
from pyspark.sql import functions as F

from millwatch.operators import drift, folds


def test_chi_square_survival():
    # tabulated quantiles
    for x, k, p in ((3.841459, 1, 0.05), (5.991465, 2, 0.05), (7.814728, 3, 0.05), (18.307038, 10, 0.05), (29.588298, 10, 0.001), (36.415029, 24, 0.05)):
        assert abs(drift.chi_square_survival(x, k) - p) < 1e-6
    assert drift.chi_square_survival(0.0, 3) == 1.0 and drift.chi_square_survival(math.inf, 3) == 0.0


def test_category_tests(spark):
    ref = spark.createDataFrame([("a", 1, 0)] * 50 + [("b", 2, 1)] * 30 + [("c", 3, 1)] * 20 + [(None, None, None)] * 5, "kind string, few int, flag int")
    cur = spark.createDataFrame([("a", 1, 0)] * 20 + [("b", 2, 0)] * 40 + [("c", 3, 1)] * 40, "kind string, few int, flag int")
    got = {r["column"]: r for r in drift.category_tests(ref, cur, ["kind", "flag"]).collect()}
    assert got["kind"]["test"] == "chi_square" and abs(got["kind"]["statistic"] - (30**2 / 50 + 10**2 / 30 + 20**2 / 20)) < 1e-9
    z = (0.5 - 0.6) ** 2 / (0.55 * 0.45 * (1 / 100 + 1 / 100))
    assert got["flag"]["test"] == "z_test" and abs(got["flag"]["statistic"] - z) < 1e-9 and abs(got["flag"]["p_value"] - math.erfc(math.sqrt(z / 2))) < 1e-12
    new = drift.category_tests(ref, cur.withColumn("kind", F.lit("z")), ["kind"]).first()
    assert new["p_value"] == 0.0 and math.isinf(new["statistic"])
    same = drift.category_tests(ref.select(F.lit("x").alias("one")), cur.select(F.lit("x").alias("one")), ["one"]).first()
    assert same["p_value"] == 1.0
    tests = {r["column"]: r["test"] for r in drift.detect(ref, cur, ["few"], ["kind", "flag"]).collect()}
    assert tests == {"few": "chi_square", "kind": "chi_square", "flag": "z_test"}


@pytest.mark.parametrize("seed", range(3))
def test_folds_of_power_law_groups(spark, seed):
    r = random.Random(seed)
    sizes = [max(1, int(4000 / (i + 1) ** 1.1)) for i in range(300)]
    rows = [(f"g{i}", int(r.random() < 0.05 + 0.2 * (i % 3 == 0)), k) for i, n in enumerate(sizes) for k in range(n)]
    for some in (rows, [x for x in rows if x[0] not in {"g0", "g1", "g2"}]):
        table = {x["g"]: x["cv_fold"] for x in folds.group_folds(spark.createDataFrame(some, "g string, Response int, k int"), "g").collect()}
        assert set(table) == {x[0] for x in some} and set(table.values()) == set(range(5))
        n, p = len(some), sum(x[1] for x in some)
        weight, load = {}, [0.0] * 5
        for g, y, _ in some:
            weight[g] = weight.get(g, 0.0) + 1 / n + y / p
            load[table[g]] += 1 / n + y / p
        assert max(load) - min(load) <= max(weight.values()) + 1e-9
