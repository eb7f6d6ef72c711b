"""Trees on histograms are those of Spark ML's GBTClassifier, and the fits of a training share blocks of bins."""

import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from millwatch.operators import joins, model, trees


@pytest.fixture(scope="module")
def rows(spark):
    h = lambda k, n: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(n)).cast("double")
    d = spark.range(3000).select(F.col("id").alias("Id"), h(0, 23).alias("a"), h(1, 7).alias("b"), h(2, 100).alias("z"), (F.col("id") % 3).cast("int").alias("cv_fold"))
    return d.withColumn("Response", (F.col("a") * 2 + F.col("b") * 3 + F.col("z") * 0.3 > 60).cast("int")).drop("z").cache()


def test_as_spark_ml(spark, rows, monkeypatch):
    """Without bagging and with values few enough to be bins; margins are stored after every second round."""
    monkeypatch.setattr(trees, "KEEP", 2)
    monkeypatch.setattr(trees, "BLOCK", 256)
    m = model.fit_one(rows, ["a", "b"], {}, stop=F.col("cv_fold") == 0, rounds=4, depth=3, share=1.0)
    n, p = rows.where("cv_fold <> 0").agg(F.count("*"), F.sum("Response")).first()
    w = F.when(F.col("Response") == 1, n / (2 * p)).otherwise(n / (2 * (n - p)))
    t = rows.select("Id", "a", "b", array_to_vector(F.array("a", "b")).alias("_v"), (F.col("cv_fold") == 0).alias("_stop"), w.alias("_w"), F.col("Response").cast("double").alias("_y"))
    ml = GBTClassifier(featuresCol="_v", labelCol="_y", weightCol="_w", validationIndicatorCol="_stop", maxIter=4, maxDepth=3, stepSize=0.1, subsamplingRate=1.0, minInstancesPerNode=20).fit(t)
    assert len(m.trees) == ml.getNumTrees > 2
    both = model.score(ml.transform(t).select("Id", "a", "b", vector_to_array("probability")[1].alias("q")), m, ["a", "b"], {}, "p").collect()
    assert len(both) == 3000 and max(abs(r["p"] - r["q"]) for r in both) < 1e-12
    assert max(abs(x - y) for x, y in zip(m.importances(), ml.featureImportances.toArray(), strict=True)) < 1e-12
    assert trees.Trees.of(m.text()) == m


def test_blocks_are_made_once(spark, rows, monkeypatch):
    """Five passes a tree and fit read bins; values are binned once, and medians nobody asks for are not looked for."""
    packed, asked = [], []
    pack, fill = trees.pack, model.fill_values
    monkeypatch.setattr(trees, "pack", lambda *a: packed.append(a) or pack(*a))
    monkeypatch.setattr(model, "fill_values", lambda df, features: asked.append(features) or fill(df, features))
    holed = rows.withColumn("b", F.when(F.col("Id") % 10 != 0, F.col("b")))
    oof, trained = model.train_oof(holed, ["a", "b"], folds=3, rounds=2, depth=2)
    assert len(packed) == 1 and asked == [["b"]]
    assert oof.count() == 3000 and oof.where("oof_pred is null or not oof_pred between 0 and 1").count() == 0
    assert dict(trained.fills) == fill(holed, ["a", "b"]) and asked == [["b"], ["a"]]


def test_all_to_one(spark):
    a, b = spark.createDataFrame([(1, 5), (2, 6), (3, None)], "Id long, a int"), spark.createDataFrame([(1, "x"), (3, "y"), (4, "z")], "Id long, b string")
    assert sorted(map(tuple, joins.all_to_one([a, b]).select("Id", "a", "b").collect())) == [(1, 5, "x"), (3, None, "y")]
    with pytest.raises(ValueError, match="Id repeats in an input: 1"):
        joins.all_to_one([a, b.union(b.where("Id = 1"))])


@pytest.mark.parametrize("label", [None, 2])
def test_labels(spark, label):
    d = spark.createDataFrame([(i, label if i == 7 else i % 2, float(i), 0) for i in range(40)], "Id long, Response int, a double, cv_fold int")
    with pytest.raises(Exception, match="Response must be 0 or 1"):
        model.fit_one(d, ["a"], {}, rounds=1)
