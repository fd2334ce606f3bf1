"""The histogram trainer against plain numpy, on any layout of the rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lotwise.operators import boosting as B
from lotwise.operators import bootstrap, models

FEATURES = ["x", "y", "z", "w"]


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    r = random.Random(4)
    rows = []
    for i in range(240):
        x, y, z = r.random(), r.random(), r.choice([0.0, 1.0, None, float("nan")])
        rows.append((i, f"b{i % 17}" if i > 60 else "big", i % 17 % 5 if i > 60 else 4, int(x + y * y + r.random() * 0.4 > 1.1), x, y, z, 3.0))
    path = str(tmp_path_factory.mktemp("boosting"))
    df = spark.createDataFrame(rows, "parcel_id long, block_id string, fold int, label int, x double, y double, z double, w double")
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def same(a, b):
    return all(np.array_equal(getattr(x, n), getattr(y, n)) for s, t in zip(a.trees, b.trees, strict=True) for x, y in zip(s, t, strict=True) for n in ("feature", "upto", "value", "cover"))


def test_gradients_equal_those_of_the_dataframe_operator(spark):
    r = random.Random(1)
    rows = [(i, i % 7 if i < 150 else 9, int(r.random() < 0.4), r.choice([0.0, r.random(), -2.0])) for i in range(200)]
    rows += [(900 + i, 50 + i % 2, i % 2, 0.5) for i in range(6)]  # lists of one label
    df = spark.createDataFrame(rows, "parcel_id long, block_id int, label int, score double")
    want = {x.parcel_id: (x.grad, x.hess) for x in models.ranking_gradients(df, "block_id", 5).collect()}
    rows.sort(key=lambda x: (x[1], x[0]))
    keys, lists, labels, scores = (np.array([x[i] for x in rows]) for i in (0, 1, 2, 3))
    g, h = B.ndcg_gradients(scores, labels.astype(float), lists, keys, 5)
    for i, k in enumerate(keys):
        assert (g[i], h[i]) == pytest.approx(want[k], abs=1e-9)


def brute_tree(bins, g, h, chosen, depth, least):
    """Values of the rows by a recursion over rows."""
    out = np.zeros(bins.shape[1])

    def go(rows, level):
        G, H = g[rows].sum(), h[rows].sum()
        best = (1e-9, None)
        for f in chosen if level < depth else ():
            for b in range(B.BINS):
                left = rows[bins[f, rows] <= b]
                gl, hl = g[left].sum(), h[left].sum()
                if hl >= least and H - hl >= least:
                    gain = gl**2 / (hl + 1) + (G - gl) ** 2 / (H - hl + 1) - G**2 / (H + 1)
                    if gain > best[0] + 1e-12:
                        best = (gain, (f, b))
        if best[1] is None:
            out[rows] = G / (H + 1)
            return
        f, b = best[1]
        go(rows[bins[f, rows] <= b], level + 1)
        go(rows[bins[f, rows] > b], level + 1)

    go(np.arange(bins.shape[1]), 0)
    return out


def test_a_tree_is_the_greedy_one(table):
    model = B.train(table, FEATURES, [B.Spec(3, 0.5, 42)], 1, "logistic", subsample=1.0, colsample=1.0, least_child=1.0)
    rows = table.orderBy("parcel_id").toPandas()
    bins = B.binned([__import__("pyarrow").array(rows[f].to_numpy()) for f in FEATURES], model.edges)
    p = np.full(len(rows), 0.5)
    want = brute_tree(bins, rows.label.to_numpy() - p, p * (1 - p), range(4), 3, 1.0)
    assert np.allclose(model.trees[0][0].predict(bins), want)
    got = {r.parcel_id: r.score for r in model.score(table, ["parcel_id"]).collect()}
    assert np.allclose([got[i] for i in rows.parcel_id], 0.5 * want)


def test_trees_do_not_depend_on_the_layout(table, monkeypatch):
    specs = [B.Spec(3, 0.1, 42, f) for f in (0, 4)] + [B.Spec(2, 0.3, 7)]
    one = B.train(table, FEATURES, specs, 5, "ndcg", fold="fold")  # one chunk, models over the tasks
    monkeypatch.setattr(B, "CHUNK", 64)
    monkeypatch.setattr(B, "KEEP", 3)
    many = B.train(table, FEATURES, specs, 5, "ndcg", fold="fold")  # chunks in several tasks, states written twice
    packed = B.packed(table, FEATURES, many.edges, 1, (), "parcel_id", "label", "block_id", "fold").collect()
    assert len(packed) > 2 and sum(r.n for r in packed) == 240
    monkeypatch.setattr(B, "CHUNK", 100)
    assert same(one, many)
    assert same(many, B.train(table.repartition(3), FEATURES, specs, 5, "ndcg", fold="fold"))
    assert any((t.feature > 0).any() for s in many.trees for t in s)


def test_many_models_make_chunks_of_few_rows(table, monkeypatch):
    weights = [bootstrap.poisson_weight(F.col("parcel_id"), run) for run in range(6)]
    specs = [B.Spec(2, 0.1, 42 + run) for run in range(6)]
    args = table, FEATURES, specs, 2, "logistic"
    one = B.train(*args, weights=weights, least_child=1.0)
    monkeypatch.setattr(B, "CHUNK", 128)
    monkeypatch.setattr(B, "CELLS", 60)
    state = B.packed(table, FEATURES, one.edges, 6, weights, "parcel_id", "label", None, None).collect()
    assert sum(r.n for r in state) == 240 and max(r.n for r in state) <= 10
    assert sorted(np.concatenate([np.frombuffer(r.keys, np.int64) for r in state])) == list(range(240))
    assert same(one, B.train(*args, weights=weights, least_child=1.0))


def test_a_list_beyond_a_chunk_is_dealt(table, monkeypatch):
    monkeypatch.setattr(B, "CHUNK", 16)
    state = B.packed(table, FEATURES, B.bin_edges(table, FEATURES), 1, (), "parcel_id", "label", "block_id", "fold").collect()
    keys = np.concatenate([np.frombuffer(r.keys, np.int64) for r in state])
    assert sorted(keys) == list(range(240)) and max(r.n for r in state) < 61
    assert all(np.frombuffer(r.lists, np.int32).max() < r.n for r in state)


def test_held_out_rows_teach_nothing_and_looks_are_runs_of_their_own(table):
    folds = [B.Spec(3, 0.1, 42, f) for f in range(5)]
    seen = {(r.model, r.n_estimators, r.parcel_id): r.score for r in models.rankers_out_of_fold(table, FEATURES, folds, [2, 4]).collect()}
    assert len(seen) == 480
    for n in (2, 4):
        for f in (1, 4):
            turned = table.withColumn("label", F.when(F.col("fold") == f, 1 - F.col("label")).otherwise(F.col("label")))
            model = B.train(turned, FEATURES, [folds[f]], n, "ndcg", fold="fold")
            for r in model.score(table.where(F.col("fold") == f), ["parcel_id"]).collect():
                assert r.score == pytest.approx(seen[f, n, r.parcel_id], abs=1e-12)


def test_no_rows(table):
    model = B.train(table.where("false"), FEATURES, [B.Spec(2)], 2)
    assert {r.score for r in model.score(table, ["parcel_id"]).collect()} == {0.0}


def test_grid_search_marks_the_first_best(table, monkeypatch):
    grid = {"n_estimators": [1, 3], "max_depth": [2, 3], "learning_rate": [0.1, 0.3]}
    got = models.grid_search(table, FEATURES, grid).collect()
    assert [(r.n_estimators, r.max_depth, r.learning_rate) for r in got] == [(n, d, s) for n in (1, 3) for d in (2, 3) for s in (0.1, 0.3)]
    best = [r for r in got if r.is_best]
    assert len(best) == 1 and all(r.mean_ndcg < best[0].mean_ndcg for r in got[: got.index(best[0])]) and max(r.mean_ndcg for r in got) == best[0].mean_ndcg
    cv = models.cross_validate_ranker(table, FEATURES, range(5), 3, 3, 0.3)
    from lotwise.operators.evaluation import ndcg_at_k

    mean = np.mean([r.ndcg for r in ndcg_at_k(cv).collect()])
    assert mean == pytest.approx(got[7].mean_ndcg)


def test_bootstrap_draws_have_their_own_weights(table):
    df = table.withColumnRenamed("label", "proxy_label")
    long = {(r.run, r.parcel_id): r.p for r in bootstrap.bootstrap_scores(df, df, FEATURES[:2], runs=4, n_estimators=2).collect()}
    assert len(long) == 4 * 240
    drawn = B.train(df, FEATURES[:2], [B.Spec(3, 0.05, 44)], 2, "logistic", label="proxy_label", weights=[bootstrap.poisson_weight(F.col("parcel_id"), 2)], least_child=1.0)
    alone = {r.parcel_id: 1 / (1 + np.exp(-r.score)) for r in drawn.score(df, ["parcel_id"]).collect()}
    low, high = min(alone.values()), max(alone.values())
    for k, v in alone.items():
        assert long[2, k] == pytest.approx((v - low) / (high - low + 1e-9) * 100, abs=1e-6)
    assert len({tuple(round(long[run, k], 6) for k in range(240)) for run in range(4)}) == 4


def shapley_by_enumeration(tree, bins, row):
    """From the definition, with the expectation of a tree by the covers below a decision on an unknown feature."""
    import itertools
    import math

    def value(known, at=0):
        if at >= len(tree.feature):
            return tree.value[at - len(tree.feature)]
        f, left, right = tree.feature[at], 2 * at + 1, 2 * at + 2
        if f in known or tree.upto[at] == B.ALL_LEFT:
            return value(known, right if bins[f, row] > tree.upto[at] else left)
        total = tree.cover[left] + tree.cover[right]
        return (tree.cover[left] * value(known, left) + tree.cover[right] * value(known, right)) / total

    n, out = len(bins), []
    for f in range(n):
        others = [x for x in range(n) if x != f]
        out.append(sum(
            math.factorial(k) * math.factorial(n - k - 1) / math.factorial(n) * (value({*s, f}) - value(set(s)))
            for k in range(n) for s in itertools.combinations(others, k)
        ))
    return out, value(set())


def test_shapley_values_of_trees_are_exact(table):
    model = B.train(table, FEATURES, [B.Spec(4, 0.3, 42)], 6, "ndcg")
    rows = table.orderBy("parcel_id").toPandas()
    bins = B.binned([__import__("pyarrow").array(rows[f].to_numpy()) for f in FEATURES], model.edges)
    got = {r.parcel_id: [r[f"shap_{f}"] for f in FEATURES] for r in model.contributions(table, ["parcel_id"]).collect()}
    score = {r.parcel_id: r.score for r in model.score(table, ["parcel_id"]).collect()}
    for row in range(0, 240, 13):
        each = [shapley_by_enumeration(step[0], bins, row) for step in model.trees]
        want = 0.3 * np.sum([x for x, _ in each], axis=0)
        mean = 0.3 * sum(m for _, m in each)
        assert got[row] == pytest.approx(list(want), abs=1e-9)
        assert sum(got[row]) == pytest.approx(score[row] - mean, abs=1e-9) and model.expected() == pytest.approx(mean, abs=1e-9)


def test_sums_added_by_the_driver_or_in_a_shuffle_give_the_same_trees(table, monkeypatch):
    monkeypatch.setattr(B, "CHUNK", 64)
    specs = [B.Spec(3, 0.1, 42, 0), B.Spec(2, 0.3, 7)]
    by_driver = B.train(table, FEATURES, specs, 3, "ndcg", fold="fold")
    monkeypatch.setattr(B, "DRIVER_SUMS", 0)
    assert same(by_driver, B.train(table, FEATURES, specs, 3, "ndcg", fold="fold"))
