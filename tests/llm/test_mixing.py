import math
import random
from collections import Counter

import numpy as np
import pytest
import xxhash

from lotwise.llm import mixing as M


def bucket(word):
    h = xxhash.xxh64_intdigest(word.strip(M.PUNCTUATION).encode(), seed=42)
    return (h - (1 << 64) if h >= 1 << 63 else h) % M.BUCKETS


def text(kind, seed):
    r = random.Random(seed)
    own = {"a": ["red", "blue,", "sky"], "b": ["iron", "Coal.", "mine"], "c": ["sun"]}[kind]
    return " ".join(r.choice(own + ["the", "of", "and"]) for _ in range(r.randint(1, 40)))


def rows():
    out = [(i, text("aaaab"[i % 5], i), "clash") for i in range(80)]
    return out + [(90, None, None), (91, "", None), (92, "x " * 9000, None), (5, out[5][1], None), (None, "the red", None)]


def test_posteriors_and_rates_equal_brute_force(spark):
    docs = spark.createDataFrame(rows(), "doc_id long, text string, rate string")
    kind = lambda i: "aaaab"[i % 5]
    labelled = spark.createDataFrame([(i, kind(i)) for i in range(40)] + [(3, "z"), (None, "b"), (7, None)], "doc_id long, domain string")
    classes = M.classifier(docs, labelled)
    assert classes.domains == ["a", "b"]
    counts = {"a": Counter(), "b": Counter()}
    for i, t, _ in rows():
        if i is not None and i < 40:
            counts[kind(i)].update(map(bucket, (t or "").lower().split()))
    members = M.memberships(docs, classes).cache()
    got = M.with_rates(members, rates := M.fit(members, classes, {"a": 0.5, "b": 0.5}, tolerance=1e-9)).collect()
    assert len(got) == len(rows())
    prior = {"a": 32 / 40, "b": 8 / 40}
    for r in got:
        words = (r.text or "").lower().split()
        logs = [math.log(prior[d]) + sum(math.log((counts[d][b] + 0.1) / (sum(counts[d].values()) + 0.1 * M.BUCKETS)) for b in map(bucket, words)) for d in "ab"]
        odds = [math.exp(x - max(logs)) for x in logs]
        assert r.n_tokens == len(words) and r.posterior == pytest.approx([o / sum(odds) for o in odds], abs=1e-9)
        assert r.copies in (math.floor(r.rate), math.floor(r.rate) + 1) and r.rate >= 0
    n, p, rate = (np.array([x for x in v]) for v in zip(*((r.n_tokens, r.posterior, r.rate) for r in got)))
    assert (n * rate) @ p == pytest.approx(np.array([0.5, 0.5]) * n.sum(), rel=1e-4)
    assert rates.residual < 1e-6


def test_rates_reach_zero_and_absent_domains_are_left_out(spark):
    members = spark.createDataFrame([(1, 10, [1.0, 0.0]), (2, 10, [0.0, 1.0]), (3, 10, [0.2, 0.8])], "doc_id long, n_tokens long, posterior array<double>")
    classes = M.Classes(["a", "b"], [0.5, 0.5], None)
    fitted = M.fit(members, classes, {"a": 1.0, "b": 0.0, "missing": 3.0})
    rate = {r.doc_id: r.rate for r in M.with_rates(members, fitted).collect()}
    assert rate[2] == pytest.approx(0, abs=1e-2) and rate[1] > 2.5 and fitted.residual < 1e-3


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame(rows(), "doc_id long, text string, rate string")
    none = spark.createDataFrame([], "doc_id long, domain string")
    classes = M.classifier(docs, none)
    members = M.memberships(docs, classes)
    assert {r.copies for r in M.with_rates(members, M.fit(members, classes, {"a": 1.0})).collect()} == {1}
    empty = M.memberships(docs.where("false"), classes)
    assert M.with_rates(empty, M.fit(empty, classes, {})).collect() == []


def test_sums_of_a_step_are_those_of_the_rates(spark):
    from pyspark.sql import functions as F

    r = M.Rates([([0.01 * (i % 3), -0.002 * i], 0.5) for i in range(20)], 0.0, [0.0, 0.0])
    rows = spark.range(0, 40, 1, 4).selectExpr("id%9 n_tokens", "array(id%10/10.0D, 1-id%10/10.0D) posterior")
    for ends in (False, True):
        want = rows.agg(*(F.sum(F.col("n_tokens") * F.get("posterior", F.lit(i)) * r.column(ends)) for i in range(2))).first()
        assert np.allclose(r.sums(rows, ends), list(want))


def test_few_steps_meet_targets_that_few_documents_meet(spark):
    """All tokens from one domain, which most documents share with the other; it took more than a thousand steps."""
    rows = [(i, 50 + i % 70, [1 - 10.0 ** -(i % 40 / 4), 10.0 ** -(i % 40 / 4)]) for i in range(4000)]
    members = spark.createDataFrame(rows, "doc_id long, n_tokens long, posterior array<double>")
    fitted = M.fit(members, M.Classes(["a", "b"], [0.5, 0.5], None), {"a": 1.0, "b": 0.0})
    assert fitted.residual <= 1e-4 and len(fitted.steps) <= 40
    plan = M.with_rates(members, fitted)._jdf.queryExecution().toString()
    assert "InArrow" not in plan and "Python" not in plan
    n, p, rate = (np.array(x) for x in zip(*((r.n_tokens, r.posterior, r.rate) for r in M.with_rates(members, fitted).collect())))
    assert (n * rate) @ p == pytest.approx([n.sum(), 0], abs=2e-4 * n.sum()) and (rate >= 0).all()
