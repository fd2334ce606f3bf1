import numpy as np
import pytest
from pyspark.sql import functions as F

from lotwise.operators import order_stats as O


@pytest.fixture
def skewed(spark):
    """One group holds most rows; one value holds a third of all rows; some nulls."""
    rng = np.random.default_rng(7)
    rows = []
    for i in range(6000):
        g = "hot" if i % 10 < 8 else f"g{i % 37}"
        v = 5.0 if i % 3 == 0 else (None if i % 41 == 0 else float(np.round(rng.normal(10, 4), 3)))
        rows.append((g, v))
    return spark.createDataFrame(rows, "g string, v double").cache()


def test_global_quantiles_by_brackets_match_numpy(skewed, monkeypatch):
    monkeypatch.setattr(O, "BRACKET_ROWS", 40)
    v = np.array([r.v for r in skewed.where("v is not null").collect()])
    probs = [0.0, 0.01, 0.2, 0.333, 0.5, 0.8, 0.99, 1.0]
    got = O.global_quantiles(skewed, {"v": ("v", probs), "none": (F.lit(None).cast("double"), [0.5])})
    assert np.allclose(got["v"], np.quantile(v, probs))
    assert got["none"] == [None]


def test_value_positions_same_for_any_bucket_count(skewed, monkeypatch):
    small = {tuple(r) for r in O.value_positions(skewed, ["g"], "v").select("g", "v", "n", "below", "total").collect()}
    monkeypatch.setattr(O, "BUCKET_ROWS", 50)
    large = {tuple(r) for r in O.value_positions(skewed, ["g"], "v").select("g", "v", "n", "below", "total").collect()}
    assert small == large
    assert sum(r[2] for r in small) == skewed.where("v is not null").count()


def test_grouped_quantiles_large_groups_take_the_second_way(skewed, monkeypatch):
    wanted = [(F.col("v"), {"p50": 0.5, "p90": 0.9})]
    plain = {r.g: r for r in O.grouped_quantiles(skewed, ["g"], wanted, [F.avg("v").alias("m")]).collect()}
    monkeypatch.setattr(O, "BUCKET_ROWS", 50)
    split = {r.g: r for r in O.grouped_quantiles(skewed, ["g"], wanted, [F.avg("v").alias("m")], group_rows=100).collect()}
    assert plain.keys() == split.keys()
    for g in plain:
        for c in ("p50", "p90", "m"):
            assert plain[g][c] == pytest.approx(split[g][c], abs=1e-9)


def test_nan_and_infinities_rank_alike_for_any_bucket_count(spark, monkeypatch):
    inf = float("inf")
    values = [float("nan")] * 3 + [inf] * 40 + [-inf] * 30 + [float(i % 17) for i in range(120)] + [None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    rows = lambda: sorted(tuple(map(repr, r)) for r in O.value_positions(df, [], "v").select("v", "n", "below", "total").collect())
    small = rows()
    monkeypatch.setattr(O, "BUCKET_ROWS", 10)
    assert rows() == small and len(small) == 20


def test_brackets_that_miss_are_widened(skewed, monkeypatch):
    monkeypatch.setattr(O, "BRACKET_ROWS", 5)
    monkeypatch.setattr(O, "BRACKET_ACCURACY", 3)
    v = np.array([r.v for r in skewed.where("v is not null").collect()])
    probs = [0.001, 0.1, 0.37, 0.5, 0.73, 0.999]
    assert np.allclose(O.global_quantiles(skewed, {"v": ("v", probs)})["v"], np.quantile(v, probs))
