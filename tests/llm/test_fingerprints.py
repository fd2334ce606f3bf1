import hashlib
import random

import numpy as np

from lotwise.llm import fingerprints as P


def text(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghijklmnopé") for _ in range(r.randint(2, 9))) for _ in range(n))


def slow_level(window):
    s = sum(int(P.WEIGHT[window.count(bytes([b]))]) for b in set(window))
    return (P.FULL - s) * (P.LEVELS - 1) // P.FULL


def slow_features(raw, rank):
    level = [slow_level(raw[i : i + 64]) for i in range(len(raw) - 63)]
    score = {}
    for j in range(len(level) - 63):
        run = [(rank[level[i]], i) for i in range(j, j + 64) if level[i] >= P.FLAT_LEVEL]
        if run:
            score[min(run)[1]] = score.get(min(run)[1], 0) + 1
    found = [raw[i : i + 64] for i in sorted(score) if score[i] >= P.POPULAR]
    return list(dict.fromkeys(found)) or ([raw] if raw else [])


def test_everything_equals_brute_force(spark):
    rows = [(3, text(1, 80), "x"), (5, None, "x"), (5, "", None), (7, "short", None), (9, text(2, 60), None), (10, text(2, 60), None), (11, "a" * 500, None), (12, text(3, 90) + text(1, 80), None), (12, text(4, 20), None), (None, "no id " * 30, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")
    rank = P.ranks(docs)
    n = np.zeros(P.LEVELS, int)
    for _, t, _ in rows:
        raw = (t or "").encode()
        for i in range(len(raw) - 63):
            n[slow_level(raw[i : i + 64])] += 1
    assert rank.tolist() == [sum((n[j], j) < (n[i], i) for j in range(P.LEVELS)) for i in range(P.LEVELS)]
    ordered = sorted(((i, t or "") for i, t, _ in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = []
    for k, (i, t) in enumerate(ordered):
        nxt = ordered[(k + 1) % len(ordered)][1]
        edited = t[: len(t) - len(t) // 4] + nxt[: len(t) // 4]
        f, e, g = (P.fingerprint(slow_features(x.encode(), rank)) for x in (t, edited, nxt))
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), f, e, P.likeness(f, e), P.likeness(f, g)))
    for ranges in (None, 1, 3):
        got = [tuple(r) for r in P.compare_edited(docs, rank, ranges=ranges).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)


def test_likeness():
    rank = np.arange(P.LEVELS)
    a, b = text(7, 2000).encode(), text(8, 2000).encode()
    x, y, z = (P.fingerprint(P.features([t], rank)[0]) for t in (a, b, a[: len(a) * 3 // 4] + b[: len(a) // 4]))
    assert P.likeness(x, x) == 1 and P.likeness(x, z) > 0.5 and P.likeness(x, y) < 0.1
    assert P.likeness("0:", "0:") == 1 and P.likeness("0:", x) == 0


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert P.compare_edited(docs, P.ranks(docs)).collect() == []
