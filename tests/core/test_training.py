"""Registered training queries run the operator's own rounds, depth and folds, and stop on the fold held out."""

import pytest

from millwatch.operators import model
from millwatch.plans import q_models

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("query", [q_models.m3, q_models.m6, q_models.a23, q_models.m3_report, q_models.m8])
def test_defaults(spark, monkeypatch, query):
    seen, asked, whole = [], [], model.train_oof

    def stop(train, features, fills, target, **params):
        seen.append(params)
        raise KeyError("seen enough")

    def folds(df, features, folds=5, *rest, **params):
        asked.append((folds, df.select("cv_fold").distinct().count(), rest, params))
        return whole(df, features, folds, *rest, **params)

    monkeypatch.setattr(model, "train_oof", folds)

    monkeypatch.setattr(model, "fit_one", stop)
    with pytest.raises(KeyError, match="seen enough"):
        query(spark, SF)
    assert seen and all(set(p) == {"stop"} and p["stop"] is not None for p in seen)
    assert asked and all(a == (5, 5, (), {}) for a in asked)
