"""The model queries run the operators over their whole job: all folds, combinations, trees, draws, orders and restarts."""

import heapq
import math
import random

import pytest
from pyspark.sql import functions as F

from lotwise import catalog as K
from lotwise.operators import boosting, clustering, models
from lotwise.operators.terrain_flow import OFFSETS
from lotwise.plans import suite


@pytest.fixture(scope="module")
def learning(spark, tmp_path_factory):
    r = random.Random(3)
    rows = [(i, f"b{i % 10}", i % 5, i % 3 % 2, float(i), *(r.random() for _ in K.FEATURES)) for i in range(100)]
    schema = "parcel_id int, block_id string, fold int, label int, CPI_v3 double, " + ", ".join(f"{f} double" for f in K.FEATURES)
    path = str(tmp_path_factory.mktemp("learning"))
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


class Fake:
    """In place of a fitted model: keeps what it was fitted with, and scores by a column."""

    def __init__(self, calls):
        self.calls = calls

    def __call__(self, df, features, *args, **params):
        self.calls.append((params, sorted(r.fold for r in df.select("fold").distinct().collect())))
        score = lambda d: d.withColumn("score", F.col("CPI_v3") * 1.0).withColumn("predicted", F.lit(1))
        return type("Fitted", (), {"transform": staticmethod(score), "__call__": lambda s, d: score(d)})()


OTHERS = [[f for f in range(5) if f != out] for out in range(5)]


def test_grid_search_tries_all_combinations_of_the_ranker_on_all_folds(spark, learning, monkeypatch):
    calls = []
    monkeypatch.setattr(suite, "model_input", lambda *_: learning)
    real = boosting.train

    def short(df, features, specs, n_trees, *args, **kw):
        calls.append((n_trees, {(s.depth, s.rate, s.fold) for s in specs}, len(specs)))
        return real(df, features, specs[:5], 2, *args, **kw)

    monkeypatch.setattr(boosting, "train", short)
    monkeypatch.setattr(boosting.Boosted, "out_of_fold", lambda self, df, keep, looks: df.select(*keep, F.explode(F.sequence(F.lit(0), F.lit(44))).alias("model"), F.lit(sorted(looks)).alias("n"), "CPI_v3").where("model%5=fold").select(*keep, "model", F.explode("n").alias("n_estimators"), F.col("CPI_v3").alias("score")))
    got = suite.QUERIES["grid_search"](spark, "").collect()
    assert len({(r.n_estimators, r.max_depth, r.learning_rate) for r in got}) == 27 and sum(r.is_best for r in got) == 1
    assert calls == [(300, {(d, r, f) for d in (3, 4, 5) for r in (0.03, 0.05, 0.1) for f in range(5)}, 45)]


def test_ranker_and_forest_run_with_their_defaults_on_all_folds(spark, learning, monkeypatch):
    monkeypatch.setattr(suite, "model_input", lambda *_: learning)
    calls = []
    monkeypatch.setattr(models, "fit_forest", Fake(calls))
    rows = suite.QUERIES["model_forest"](spark, "").collect()
    assert sorted(map(str, calls)) == sorted(str(({}, o)) for o in OTHERS)
    assert {r.fold for r in rows} == set(range(5))
    ranked = suite.QUERIES["model_ranker"](spark, "").collect()
    assert len({r.parcel_id for r in ranked}) == len(ranked) == 100 and {r.fold for r in ranked} == set(range(5))
    for f in range(5):  # each fold is scaled by its own ends
        scaled = [r.CPI_ML_v3 for r in ranked if r.fold == f]
        assert min(scaled) == 0.0 and max(scaled) == 100.0


def test_fitted_bootstrap_runs_all_draws(spark, learning, monkeypatch):
    labelled = learning.withColumnRenamed("label", "proxy_label").withColumn("is_valid", F.lit(True))
    monkeypatch.setattr(suite.P, "scored", lambda *_: labelled)
    calls, real = [], boosting.train

    def short(df, features, specs, n_trees, *args, **kw):
        calls.append((n_trees, sorted(s.seed for s in specs), len(kw["weights"])))
        return real(df, features, specs, 1, *args, **kw)

    monkeypatch.setattr(boosting, "train", short)
    got = suite.QUERIES["bootstrap_ci_fitted"](spark, "").collect()
    assert len(got) == 100 and calls == [(100, list(range(42, 142)), 100)]
    assert all(r.cpi_ml_ci_low <= r.cpi_ml_mean <= r.cpi_ml_ci_high for r in got)


def test_shapley_and_label_check_run_with_their_defaults(spark, learning, monkeypatch):
    forests, orders, restarts = [], [], []
    monkeypatch.setattr(suite, "model_input", lambda *_: learning)
    monkeypatch.setattr(suite.P, "scored", lambda *_: learning.withColumn("is_valid", F.lit(True)))
    monkeypatch.setattr(models, "fit_forest", Fake(forests))
    monkeypatch.setattr(models, "sampled_shapley", lambda *a, **kw: orders.append((len(a), kw)) or learning)
    monkeypatch.setattr(clustering, "validate_labels", lambda *a, **kw: restarts.append((len(a), kw)) or (learning, learning))
    suite.QUERIES["shap_values_sampled"](spark, "")
    suite.QUERIES["validate_labels"](spark, "")
    assert [p for p, _ in forests] == [{}] and orders == [(3, {})] and restarts == [(1, {})]


def filled_by_heap(z, eps=1e-4):
    """Least surface on which every cell drains: lowest water first, from cells at the edge or beside nodata."""
    known = {k: v for k, v in z.items() if v is not None}
    near = {(r, c): [(r + a, c + b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b] for r, c in known}
    heap = [(v, k) for k, v in known.items() if not all(n in known for n in near[k])]
    water = {}
    heapq.heapify(heap)
    while heap:
        w, k = heapq.heappop(heap)
        if k not in water:
            water[k] = w
            for n in near[k]:
                if n in known and n not in water:
                    heapq.heappush(heap, (max(known[n], w + eps), n))
    return water


def test_drainage_of_the_filled_surface(spark, sf):
    z = {(r.r, r.c): r.z for r in suite.S.cells(spark, sf).collect()}
    w, down = filled_by_heap(z), {}
    for (r, c), v in w.items():
        drops = [((v - w[r + a, c + b]) / math.hypot(a, b), -i, (r + a, c + b)) for i, (a, b) in enumerate(OFFSETS.values()) if (r + a, c + b) in w]
        best = max((d for d in drops if d[0] > 0), default=None)
        down[r, c] = best and best[2]
    count = dict.fromkeys(z)
    for k in w:
        while k is not None:
            count[k] = (count[k] or 0) + 1
            k = down[k]
    got = {(r.r, r.c): r.accumulation for r in suite.QUERIES["flow_accumulation_d8_filled"](spark, sf).collect()}
    assert got == count
    pits = suite.terrain_flow.flow_accumulation(suite.terrain_flow.d8_pointers(suite.S.cells(spark, sf), "z"))
    raw = {(r.r, r.c): r.accumulation for r in pits.collect()}
    assert sum(v or 0 for v in got.values()) > sum(v or 0 for v in raw.values())  # the sum of all path lengths, which pits cut
    assert got == {(r.r, r.c): r.accumulation for r in suite.QUERIES["flow_accumulation_d8"](spark, sf).collect()}
    mask = {(r.r, r.c): r.thalweg for r in suite.QUERIES["thalweg_mask_filled"](spark, sf).collect()}
    assert mask == {k: None if v is None else int(v >= K.THALWEG_MIN_CELLS) for k, v in count.items()}
    slope = {(r.r, r.c): r.slope_deg for r in suite.raster.slope(suite.S.cells(spark, sf)).collect()}
    for r in suite.QUERIES["twi_filled"](spark, sf).collect():
        n, s = count[r.r, r.c], slope[r.r, r.c]
        want = None if n is None or s is None else min(K.TWI_CAP, math.log(n * 0.25 / math.tan(math.radians(max(s, 0.5)))))
        assert r.twi == (None if want is None else pytest.approx(want, abs=1e-6))
