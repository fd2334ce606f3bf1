import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lotwise import catalog as K
from lotwise.functions.numeric import half_even, ladder
from lotwise.operators import bootstrap, clustering, consensus, evaluation, labeling, models, scoring, screening


def test_half_even_matches_numpy(spark):
    values = [0.25, 0.35, 52.25, 72.25, 72.35, -0.25, 1.05, 99.95]
    df = spark.createDataFrame([(v,) for v in values], "v double").select(half_even(F.col("v")).alias("r"))
    assert [r.r for r in df.collect()] == list(np.round(values, 1))


def test_softmin_lies_between_minimum_and_mean_even_for_small_tau(spark):
    df = spark.createDataFrame([(0.0, 100.0, 50.0, 20.0), (5.0, 5.0, 5.0, 5.0)], "a double, b double, c double, d double")
    cols = [F.col(c) for c in "abcd"]
    for tau in (1e-3, 0.1, 10.0, 1e4):
        for r in df.select(scoring.softmin(cols, tau).alias("s"), *cols).collect():
            v = [r.a, r.b, r.c, r.d]
            assert min(v) - 1e-9 <= r.s <= sum(v) / 4 + 1e-9


def test_degenerate_scaling_is_one_half_even_inverted(spark):
    df = spark.createDataFrame([(3.0,), (None,), (3.0,)], "x double")
    s = scoring.fit_raw_scaling(df, ["x"])
    assert {r.n for r in df.select(scoring.normalized(s, "x", True).alias("n")).collect()} == {0.5}


def test_tau_tree_follows_plain_bisection(spark):
    rng = np.random.default_rng(1)
    g = rng.uniform(0, 100, (200, 4))
    df = spark.createDataFrame([tuple(map(float, r)) for r in g], "p double, h double, m double, s double").cache()

    def std(tau):
        w = np.exp(-(g - g.min(1, keepdims=True)) / tau)
        return float((0.7 * g.mean(1) + 0.3 * (w / w.sum(1, keepdims=True) * g).sum(1)).std())

    target = std(7.0)
    lo, hi = 0.5, 100.0
    for _ in range(12):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if std(mid) < target else (mid, hi)
    assert scoring.calibrate_tau(df, target, steps=12, depth=4) == pytest.approx((lo + hi) / 2)


def test_gates_never_raise_a_score_and_reasons(spark):
    rows = list(itertools.product([10.0, 60.0, 0.0], [None, 0.1, 0.3], [None, 20.0, 26.0], [None, 0.5, 0.9]))
    df = spark.createDataFrame(rows, "cpi_brut double, has_thalweg_mean double, slope_p90 double, ces_existant double")
    for r in scoring.final_score(scoring.gates(df)).collect():
        assert r.CPI_v3 <= r.cpi_brut + 1e-9
        steep, wet, full = (r.slope_p90 or 0) > 25, (r.has_thalweg_mean or 0) > 0.2, (r.ces_existant or 0) > 0.8
        want = K.GATE_BOTH if steep else K.GATE_THALWEG if wet else K.GATE_COVERAGE if full else ""
        assert r.gate_reason == want
    strict = scoring.gates(df, strict_reasons=True).where("slope_p90>25 and coalesce(has_thalweg_mean,0)<=0.2").select("gate_reason").distinct().collect()
    assert [r.gate_reason for r in strict] == [K.GATE_SLOPE]


def test_ladder_bounds(spark):
    df = spark.createDataFrame([(19.9,), (20.0,), (82.0,)], "v double")
    assert [r[0] for r in df.select(ladder(F.col("v"), K.LADDER_FINAL)).collect()] == ["Eliminatoire", "Faible", "Excellent"]


def test_vote_truth_tables(spark):
    bits = [(a, b, c, d, e, f) for a, b, c, d in itertools.product([0, 1], repeat=4) for e, f in ((0, 0), (1, 0), (0, 1))]
    df = spark.createDataFrame(bits, "h1 int, h2 int, h3 int, h4 int, h5_pos int, h5_neg int")
    count = lambda d: {r.proxy_label: r["count"] for r in d.groupBy("proxy_label").count().collect()}
    assert count(labeling.vote(df, True)) == {1: 22, 0: 20, -1: 6}
    assert count(labeling.vote(df.where("h5_pos=0 and h5_neg=0"), False)) == {1: 8, 0: 6, -1: 2}


def ranking(spark, n=200, seed=2):
    rng = np.random.default_rng(seed)
    rows = [(i, int(i % 3 > 0), int(rng.integers(0, 2)), float(np.round(rng.uniform(0, 5), 1)), f"b{i % 11 if i % 3 else 0}") for i in range(n)]
    return rows, spark.createDataFrame(rows, "parcel_id int, fold int, label int, score double, block_id string").cache()


def test_ranking_metrics(spark):
    rows, df = ranking(spark)
    perfect = df.withColumn("score", F.col("label").cast("double"))
    assert all(r.ndcg == pytest.approx(1.0) for r in evaluation.ndcg_at_k(perfect).collect())
    assert all(r.auc == pytest.approx(1.0) for r in evaluation.auc(perfect).collect())
    for r in evaluation.auc(df).collect():
        pos = [x[3] for x in rows if x[1] == r.fold and x[2] == 1]
        neg = [x[3] for x in rows if x[1] == r.fold and x[2] == 0]
        want = np.mean([(p > q) + 0.5 * (p == q) for p in pos for q in neg])
        assert r.auc == pytest.approx(want)
    for r in evaluation.ndcg_at_k(df, 7).collect():
        part = sorted((x for x in rows if x[1] == r.fold), key=lambda x: (-x[3], x[0]))[:7]
        ideal = min(7, sum(x[2] for x in rows if x[1] == r.fold))
        want = sum(x[2] / math.log2(i + 2) for i, x in enumerate(part)) / sum(1 / math.log2(i + 2) for i in range(ideal))
        assert r.ndcg == pytest.approx(want)


def test_folds_keep_blocks_whole(spark):
    _, df = ranking(spark)
    f = evaluation.group_kfold(df, 4)
    assert f.where("fold is null").count() == 0 and f.count() == df.count()
    assert f.groupBy("block_id").agg(F.count_distinct("fold").alias("n")).where("n>1").count() == 0
    assert f.select("fold").distinct().count() == 4
    with pytest.raises(ValueError):
        evaluation.group_kfold(df.where("block_id='b0'"))


def test_folds_equal_the_plain_greedy_rule(spark):
    import random

    for seed, sizes in ((1, [1, 2, 3]), (2, [1]), (3, [5, 5, 5, 1, 40, 7])):
        r = random.Random(seed)
        blocks = {f"b{i:03d}": r.choice(sizes) for i in range(90)}
        df = spark.createDataFrame([(b,) for b, n in blocks.items() for _ in range(n)], "block_id string")
        loads, want = [0] * 4, {}
        for b, n in sorted(blocks.items(), key=lambda x: (-x[1], x[0])):
            want[b] = loads.index(min(loads))
            loads[want[b]] += n
        assert {x.block_id: x.fold for x in evaluation.group_kfold(df, 4).distinct().collect()} == want


def test_ranking_gradients_pair_only_with_the_head(spark):
    rows, df = ranking(spark, 60)
    got = {r.parcel_id: (r.grad, r.hess) for r in models.ranking_gradients(df, "fold", 4).collect()}
    want = {x[0]: [0.0, 0.0] for x in rows}
    for fold in (0, 1):
        part = sorted((x for x in rows if x[1] == fold), key=lambda x: (-x[3], x[0]))
        disc = {x[0]: 1 / math.log2(i + 2) if i < 4 else 0.0 for i, x in enumerate(part)}
        ideal = sum(1 / math.log2(i + 2) for i in range(min(4, sum(x[2] for x in part))))
        for i, a in enumerate(part):
            for b in part[:i]:
                if disc[b[0]] and a[2] != b[2]:
                    hi, lo = (a, b) if a[2] > b[2] else (b, a)
                    rho = 1 / (1 + math.exp(hi[3] - lo[3]))
                    w = abs(disc[a[0]] - disc[b[0]]) / ideal
                    want[hi[0]][0] += rho * w
                    want[lo[0]][0] -= rho * w
                    for x in (hi, lo):
                        want[x[0]][1] += rho * (1 - rho) * w
    for k, (g, h) in want.items():
        assert got[k] == pytest.approx((g, h), abs=1e-9)


def test_consensus_of_a_parcel_without_scores(spark):
    df = spark.createDataFrame([(1, 1.0, 5.0), (2, 1.0, None), (3, 4.0, 2.0), (4, None, None)], "parcel_id int, a double, b double")
    got = {r.parcel_id: r for r in consensus.consensus(df, ["a", "b"]).collect()}
    assert got[2].consensus_score == pytest.approx(50.0) and got[2].n_approaches_used == 1 and got[2].consensus_confidence == 1.0
    assert got[4].consensus_score is None and got[4].n_approaches_used == 0
    assert got[1].consensus_score == pytest.approx((50 + 100) / 2)


def test_kmeans_finds_separate_groups(spark):
    rng = np.random.default_rng(0)
    rows = [(i, float(i % 4 * 50 + rng.normal()), None if i == 3 else float((i % 4) ** 2 * 30 + rng.normal())) for i in range(200)]
    df = spark.createDataFrame(rows, "parcel_id int, slope_p50 double, slope_p90 double")
    got, centres, _ = clustering.kmeans4(df, ["slope_p50", "slope_p90", "absent"], restarts=3)
    assert len(centres) == 4
    groups = got.withColumn("true", F.col("parcel_id") % 4).where("parcel_id<>3").groupBy("true").agg(F.count_distinct("cluster_id").alias("n"))
    assert {r.n for r in groups.collect()} == {1}


def test_models_learn_and_contributions_add_up(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 3))
    rows = [(i, f"b{i % 6}", *map(float, x[i]), int(x[i, 0] + 0.5 * x[i, 1] > 0)) for i in range(300)]
    df = spark.createDataFrame(rows, "parcel_id int, block_id string, f0 double, f1 double, f2 double, label int").cache()
    feats = ["f0", "f1", "f2"]
    score = models.fit_logistic(df, feats)
    auc = evaluation.auc(score(df).withColumn("fold", F.lit(0))).first().auc
    assert auc > 0.98
    ranker = models.fit_ranker(df, feats, n_estimators=3, learning_rate=0.5)
    assert evaluation.auc(ranker.transform(df).withColumn("fold", F.lit(0))).first().auc > 0.8
    few = df.where("parcel_id<10")
    shap = {r.parcel_id: sum(r[f"shap_{f}"] for f in feats) for r in models.sampled_shapley(few, score, feats, 3).collect()}
    means = few.agg(*[F.avg(f).alias(f) for f in feats]).withColumn("parcel_id", F.lit(-1))
    base = score(means).first().score
    for r in score(few).collect():
        assert shap[r.parcel_id] == pytest.approx(r.score - base, abs=1e-9)


def test_bootstrap_draws_do_not_depend_on_partitioning(spark):
    df = spark.range(5000).withColumnRenamed("id", "parcel_id")
    draw = lambda d: sorted(map(tuple, bootstrap.bootstrap_weights(d, 2).select("run", "parcel_id", "weight").collect()))
    one = draw(df)
    assert one == draw(df.repartition(7))
    assert sum(r[2] for r in one) / 10000 == pytest.approx(0.8, abs=0.03)


def test_shortlist_and_profiles(spark):
    df = spark.createDataFrame([("73065AB1", 80.0), ("73065 AB2", 70.0)], "parcel_id string, CPI_technique double")
    asked = spark.createDataFrame([(" 73065-ab1",), ("73065AB1",), ("zz",), ("",)], "requested string")
    assert [r.parcel_id for r in screening.shortlist(df, asked).collect()] == ["73065AB1"]


def test_histogram_puts_values_on_an_edge_to_the_right(spark):
    from lotwise.operators.reporting import histogram

    values = [3.0 + k * 4.85 for k in range(21)] + [22.4, 100.0, 99.99, None]
    edges = [3.0 + k * 97.0 / 20 for k in range(21)]
    want = {}
    for v in values[:-1]:
        at = min(20, sum(v >= e for e in edges))
        want[at] = want.get(at, 0) + 1
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert {r.bin: r.n for r in histogram(df, "x").collect()} == want
    assert [(r.bin, r.n) for r in histogram(df.where("x = 3"), "x").collect()] == [(1, 1)] and histogram(df.where("x is null"), "x").collect() == []


def test_medians_that_differ_by_rounding_only_count_as_flat(spark):
    from lotwise.operators import clustering

    rows = [(0, 0.4, 1.0), (1, 0.39999999999999997, 3.0), (2, 0.4000000000000001, 2.0)]
    got = clustering.constructibility(spark.createDataFrame(rows, "cluster_id int, svf_mean double, twi_mean double"))
    assert {r.cluster_id: r.constructibility_score for r in got.collect()} == {0: 0.75, 1: 0.25, 2: 0.5}
