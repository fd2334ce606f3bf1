"""A list is compared as a whole, however many rows it has and wherever they lie."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lotwise.operators import boosting as B
from lotwise.operators import bootstrap, models

FEATURES = ["x", "y", "z"]


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    r = random.Random(8)
    rows = []
    for i in range(260):
        x, y = r.random(), r.random()
        block = "large" if i < 120 else None if i < 160 else f"b{i % 9}"
        rows.append((i, block, i % 3, int(x + y * y + r.random() * 0.6 > 1.2), x, y, r.choice([0.0, None, 2.0])))
    path = str(tmp_path_factory.mktemp("lists"))
    spark.createDataFrame(rows, "parcel_id long, block_id string, fold int, label int, x double, y double, z double").write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def same(a, b):
    return all(np.array_equal(getattr(x, n), getattr(y, n)) for s, t in zip(a.trees, b.trees, strict=True) for x, y in zip(s, t, strict=True) for n in ("feature", "upto", "value", "cover"))


@pytest.mark.parametrize("whole", [0, 1 << 21])
def test_a_list_of_many_chunks_gives_the_trees_of_one_chunk(table, monkeypatch, whole):
    specs = [B.Spec(3, 0.3, 42, 0), B.Spec(2, 0.5, 7)]
    one = B.train(table, FEATURES, specs, 4, fold="fold", k=5)
    monkeypatch.setattr(B, "CHUNK", 16)
    monkeypatch.setattr(B, "KEEP", 2)
    monkeypatch.setattr(B, "WHOLE", whole)
    assert same(one, B.train(table, FEATURES, specs, 4, fold="fold", k=5))
    assert any((t.feature > 0).any() for s in one.trees for t in s)


def test_scores_of_the_fitted_ranker_do_not_depend_on_the_size_of_a_chunk(table, monkeypatch):
    scores = lambda: {r.parcel_id: r.score for r in models.fit_ranker(table, FEATURES, n_estimators=3, learning_rate=0.5, k=5).transform(table).collect()}
    one = scores()
    monkeypatch.setattr(B, "CHUNK", 16)
    assert scores() == one


@pytest.mark.parametrize("labels", [2, 4])
def test_gradients_of_long_lists_equal_those_of_the_dataframe_operator(spark, monkeypatch, labels):
    monkeypatch.setattr(B, "LONG", 12)
    monkeypatch.setattr(B, "BLOCK", 16)
    r = random.Random(2)
    rows = [(i, i % 4 if i < 160 else 9, int(r.random() * labels), r.choice([0.0, r.random() * 5, -2.0])) for i in range(240)]
    df = spark.createDataFrame(rows, "parcel_id long, block_id int, label int, score double")
    want = {x.parcel_id: (x.grad, x.hess) for x in models.ranking_gradients(df, "block_id", 5).collect()}
    rows.sort(key=lambda x: (x[1], -x[0]))  # keys in falling order: equal scores are ranked by the lower key all the same
    keys, lists, labels, scores = (np.array([x[i] for x in rows]) for i in (0, 1, 2, 3))
    g, h = B.ndcg_gradients(scores, labels.astype(float), lists, keys, 5)
    for i, key in enumerate(keys):
        assert (g[i], h[i]) == pytest.approx(want[key], abs=1e-9)


def test_scores_far_apart_leave_finite_gradients(monkeypatch):
    scores, labels = np.linspace(-3000.0, 3000.0, 40), np.arange(40) % 2.0
    args = scores, labels, np.zeros(40, int), np.arange(40), 5
    want = B.ndcg_gradients(*args)
    monkeypatch.setattr(B, "LONG", 12)
    got = B.ndcg_gradients(*args)
    assert np.isfinite(got).all() and np.allclose(got, want, atol=1e-12)


def test_a_model_by_itself_has_the_trees_of_the_passes_over_all_chunks(table, monkeypatch):
    weights = [bootstrap.poisson_weight(F.col("parcel_id"), run) for run in range(5)]
    specs = [B.Spec(1 + run, 0.1, 42 + run, run - 1 if run else None) for run in range(5)]
    for loss in ("logistic", "ndcg"):
        monkeypatch.setattr(B, "WHOLE", 1 << 21)
        monkeypatch.setattr(B, "CHUNK", 1 << 16)
        args = table, FEATURES, specs, 3, loss
        one = B.train(*args, fold="fold", weights=weights, least_child=0.5)
        monkeypatch.setattr(B, "CHUNK", 50)
        several = B.train(*args, fold="fold", weights=weights, least_child=0.5)
        monkeypatch.setattr(B, "WHOLE", 0)
        assert same(one, several) and same(one, B.train(*args, fold="fold", weights=weights, least_child=0.5))


def test_rows_of_many_chunks_are_grown_without_a_pass_per_level(table, monkeypatch):
    monkeypatch.setattr(B, "CHUNK", 64)
    monkeypatch.setattr(B, "splits_over_tasks", None)
    assert len(B.train(table, FEATURES, [B.Spec(2, 0.5, 42, f) for f in range(3)], 2, fold="fold").trees) == 2


def test_weights_of_the_draws_are_made_after_the_shuffle(table, monkeypatch):
    monkeypatch.setattr(B, "CHUNK", 64)
    weights = [bootstrap.poisson_weight(F.col("parcel_id"), run) for run in range(2)]
    state = B.packed(table, FEATURES, B.bin_edges(table, FEATURES), 2, weights, "parcel_id", "label", None, None)
    plan = state._jdf.queryExecution().executedPlan().toString()
    assert "md5" in plan and plan.rindex("md5") < plan.index("Exchange")
