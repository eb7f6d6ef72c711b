"""Training makes its vectors once, by fold, whatever the number of fits, and scores with them."""

from pyspark.sql import functions as F

from millwatch.operators import model

FEATURES = ["a", "b"]


def rows(spark):
    """Some values are null or NaN, and some rows are in no fold."""
    a = F.when(F.col("id") % 11 == 0, F.lit(float("nan"))).otherwise((F.col("id") * 37 % 101).cast("double"))
    b = F.when(F.col("id") % 7 != 0, (F.col("id") * 13 % 29).cast("int"))
    fold = F.when(F.col("id") % 10 != 9, (F.col("id") % 3).cast("int"))
    return spark.range(600).select(F.col("id").alias("Id"), (F.col("id") * 37 % 101 > 60).cast("int").alias("Response"), a.alias("a"), b.alias("b"), fold.alias("cv_fold"))


def test_vectors(spark, monkeypatch):
    seen, whole = {}, model.fit_one

    def fit(train, features, fills, target, stop, **params):
        seen[len(seen)] = train
        return whole(train, features, fills, target, stop=stop, **params)

    monkeypatch.setattr(model, "fit_one", fit)
    df = rows(spark).cache()
    oof, trained = model.train_oof(df, FEATURES, folds=3, rounds=3, depth=3)
    # what fits read has vectors, and a fold's are files of their own
    for train in seen.values():
        assert "UDF" not in model._assemble(train, FEATURES, trained.fills)._jdf.queryExecution().optimizedPlan().toString()
        assert train.count() == 600 and train.where("cv_fold is null").count() == 60
        assert train.groupBy(F.input_file_name()).agg(F.count_distinct(F.coalesce("cv_fold", F.lit(-1))).alias("n")).where("n > 1").count() == 0
    assert len(seen) == 3 and len({id(t) for t in seen.values()}) == 1
    # each row has the score of its fold's model on its own values
    assert oof.columns == ["Id", "Response", "oof_pred", "cv_fold"] and oof.schema["cv_fold"].dataType == df.schema["cv_fold"].dataType
    got = {r["Id"]: r["oof_pred"] for r in oof.collect()}
    assert len(got) == 540
    for k, m in enumerate(trained.models):
        for r in model.score(df.where(F.col("cv_fold") == k), m, FEATURES, trained.fills).collect():
            assert got[r["Id"]] == r["pred"]


def test_report_makes_scores_once(spark):
    """The report of folds and overall reads each score once."""
    seen = spark.sparkContext.accumulator(0)

    def told(i):
        seen.add(1)
        return i % 100 / 100

    df = rows(spark).where("cv_fold is not null").withColumn("oof_pred", F.udf(told, "double")("Id"))
    got = {r["scope"]: r["rows"] for r in model.fold_report(df).collect()}
    assert got == {"fold 0": 180, "fold 1": 180, "fold 2": 180, "overall": 540}
    assert seen.value == 540
