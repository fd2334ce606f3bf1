import math
import random
from collections import Counter

import numpy as np
import pytest

from lotwise.llm import lm_score as L
from lotwise.llm.elias_fano import EliasFano, Trie


def brute(rows):
    tokens = lambda t: [*(t or "").encode().lower().split(), None]
    uni, bi, starts = Counter(), Counter(), 0
    for _, t, keep in rows:
        if keep:
            w = tokens(t)
            uni.update(w)
            bi.update(zip(["start", *w], w))
            starts += 1
    n, v = sum(uni.values()), len(uni)
    out = []
    for d, t, _ in rows:
        w = tokens(t)
        p = [(uni[x] + 1) / (n + v + 1) for x in w]
        context = [starts, *(uni[x] for x in w[:-1])]
        logs = [math.log10((bi[a, b] + L.PRIOR * q) / (c + L.PRIOR)) for a, b, q, c in zip(["start", *w], w, p, context)]
        out.append((d, len(w), sum(uni[x] > 0 for x in w), n, sum(map(math.log10, p)), sum(logs)))
    return sorted(out, key=lambda r: (repr(r[0]), r[1:]))


def text(seed):
    r = random.Random(seed)
    return " ".join(r.choice(["the", "The", "of", f"w{r.randrange(60)}", f"é{r.randrange(9)}"]) for _ in range(r.randint(0, 80)))


@pytest.mark.parametrize("per_shard", [4_000_000, 150])
def test_scores_equal_brute_force(spark, monkeypatch, per_shard):
    monkeypatch.setattr(L, "LEAST_SHARDS", 3)
    rows = [(i, text(i), i % 4 != 2) for i in range(60)]
    rows += [(70, None, True), (71, "", False), (72, "one", False), (73, "is " * 5000, True), (5, rows[5][1], True), (5, "other text", False), (None, "no id", True)]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, trained boolean, score string")
    got = sorted((tuple(r) for r in L.score(docs, "trained", per_shard=per_shard).collect()), key=lambda r: (repr(r[0]), r[1:]))
    want = brute(rows)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert np.allclose([g[4] for g in got], [w[4] for w in want], rtol=1e-12)
    assert np.allclose([g[5] for g in got], [w[5] for w in want], rtol=1e-4)


def test_nothing_trained_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert [tuple(r) for r in L.score(docs, "false").collect()] == [(1, 3, 0, 0, 0.0, pytest.approx(0))]
    assert L.score(docs.where("false"), "true").collect() == []


def test_tries_are_kept_and_mapped_again(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b a b"), (2, "a c")], "doc_id long, text string")
    rows = L.tries(docs).collect()
    sizes = []
    for r in rows:
        path = tmp_path / str(r.shard)
        path.write_bytes(bytes(r.trie))
        trie = Trie.open(str(path))
        sizes.append((trie.words.n, int(trie.count(np.arange(trie.words.n)).sum())))
    assert sum(n for n, _ in sizes) >= 4


@pytest.mark.parametrize("n, top", [(0, 9), (1, 1), (7, 3), (2000, 2**63), (3000, 3000), (5000, 2**40)])
def test_sequences_equal_sorted_arrays(n, top):
    r = np.random.default_rng(n)
    values = np.sort(r.integers(0, top, n, dtype=np.uint64))
    e = EliasFano(EliasFano.build(values))
    assert (e[np.arange(n)] == values).all()
    x = np.concatenate([r.integers(0, top, 300, dtype=np.uint64), values[:50], np.array([0, top], np.uint64)])
    assert (e.successor(x) == np.searchsorted(values, x)).all()
