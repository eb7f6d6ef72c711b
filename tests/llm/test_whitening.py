"""Whitening against a plain version in whole numbers and in long double."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from millwatch.llm import queries as Q
from millwatch.llm import whitening

SF = "/root/testdata/sf0.01"


def plain(rows, most=4):
    """{id: [deviation, ...]} and per component (whitened by id, explained) by definition; covariance in fractions."""
    x = {i: [math.floor(256 * float(c)) + 0 for c in v] for i, v in rows}
    once = sorted({tuple(v) for v in x.values()})
    n, d = len(once), len(once[0])
    s = [sum(v[k] for v in once) for k in range(d)]
    off = np.array([[n * v[k] - s[k] for k in range(d)] for v in once], dtype=object)
    cov = np.array([[float(Fraction(int(sum(off[:, a] * off[:, b])), n**3)) for b in range(d)] for a in range(d)])
    e, q = np.linalg.eigh(cov)
    e, q = e[::-1][:most], q[:, ::-1][:, :most]
    far = {i: sum((n * v[k] - s[k]) ** 2 for k in range(d)) for i, v in x.items()}
    w = {i: np.array([float(Fraction(n * v[k] - s[k], n)) for k in range(d)]) @ q / np.sqrt(e) for i, v in x.items()}
    return n, far, w, e / np.trace(cov)


def same(got, rows):
    n, far, w, explained = plain(rows)
    k = len(explained)
    assert len(got) == k * len(rows)
    sign = {}
    for r in got:
        c = r["component"] - 1
        mine = far[r["vec_id"]]
        assert r["n"] == n and r["deviation_exact"] == mine and r["deviation"] == (mine if mine < 1 << 63 else None)
        assert abs(r["explained"] / explained[c] - 1) < 1e-9 and r["identity_error"] < 1e-9
        if abs(w[r["vec_id"]][c]) > 0.1:
            sign.setdefault(c, np.sign(w[r["vec_id"]][c] * r["whitened"]))
    for r in got:
        c = r["component"] - 1
        assert abs(r["whitened"] * sign[c] - w[r["vec_id"]][c]) < 1e-6
    return got


def test_table(spark):
    rows = [(r[0], r[1]) for r in Q.table(spark, SF, "embeddings").select("vec_id", "embedding").collect()]
    same(Q.op13_whitening(spark, SF).collect(), rows)


@pytest.mark.parametrize("dims, scale", [(1, 1.0), (3, 1e-3), (5, 1e6)])
def test_random(spark, dims, scale):
    r = np.random.default_rng(dims)
    rows = [(i, (r.standard_normal(dims) * scale * np.arange(1, dims + 1)).tolist()) for i in range(150)]
    rows += [(1000 + i, rows[i][1]) for i in range(100)]  # copies count once in the fit, and give rows of their own
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(7))
    same(got.collect(), rows)


def test_chunks(spark, monkeypatch):
    """Chunks of other sizes give the same whole numbers."""
    r = np.random.default_rng(3)
    x = np.floor(r.standard_normal((1000, 6)) * 300).astype(np.int64)
    s, p = whitening.cross_products(x)
    assert (p == (x.T @ x)).all() and (s == x.sum(axis=0)).all()
    parts = [whitening.cross_products(np.ascontiguousarray(x[a : a + 77])) for a in range(0, 1000, 77)]
    assert (sum(q for _, q in parts) == p).all() and (sum(t for t, _ in parts) == s).all()
    wide = np.array([[-(1 << 63), 5], [(1 << 63) - 1, -7], [3, 0]], dtype=np.int64)
    want = [[sum(int(v[a]) * int(v[b]) for v in wide) for b in range(2)] for a in range(2)]
    assert whitening.cross_products(wide)[1].tolist() == want


def test_odd(spark):
    r = np.random.default_rng(1)
    good = [(i, r.standard_normal(4).tolist()) for i in range(40)] + [(None, [0.0] * 4), (3, [-0.0, 1e-9, -1e-9, 0.5])]
    bad = [(100, None), (101, [1.0, None, 1.0, 1.0]), (102, [float("nan")] * 4), (103, [1.0, float("inf"), 0.0, 0.0]), (104, []), (105, [1.0] * 3)]
    df = spark.createDataFrame(good + bad, "vec_id long, embedding array<double>").withColumns({"n": F.lit(1), "Component": F.lit("x"), "x": F.lit(2)})
    out = whitening.whiten(df)
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "deviation_exact", "identity_error"]
    got = out.collect()
    assert len(got) == 4 * 42 and sum(r["vec_id"] is None for r in got) == 4 and sum(r["vec_id"] == 3 for r in got) == 8
    assert {r["n"] for r in got} == {42} and got[0]["identity_error"] < 1e-9
    assert whitening.whiten(df.limit(0)).count() == 0 and whitening.whiten(df.where("vec_id >= 100")).where("vec_id < 105").count() == 0
    # one vector, constant vectors, fewer vectors than dimensions
    one = whitening.whiten(df.where("vec_id = 5")).collect()
    assert len(one) == 4 and all(r["whitened"] is None and r["explained"] == 0 and r["identity_error"] is None and r["deviation"] == 0 for r in one)
    two = sorted(whitening.whiten(df.where("vec_id in (5, 6)")).collect(), key=lambda r: (r["component"], r["vec_id"]))
    assert [r["whitened"] is None for r in two] == [False, False, True, True, True, True, True, True] and abs(two[0]["whitened"] + two[1]["whitened"]) < 1e-9
    # entries beyond long / 256 are held at its ends, and deviations that exceed a long are told exactly as a decimal
    huge = whitening.whiten(spark.createDataFrame([(1, [1e300, 1.0]), (2, [0.0, 2.0])], "vec_id long, embedding array<double>")).collect()
    assert len(huge) == 4 and all(r["deviation"] is None for r in huge) and {r["deviation_exact"] for r in huge} == {((1 << 63) - 1) ** 2 + 256**2}
