import numpy as np
import pytest

from lotwise.llm import fingerprints as P
from tests.llm.test_fingerprints import text


@pytest.mark.parametrize("words", [2, 4, 8, 20, 30])
def test_a_short_text_is_like_its_edited_text(spark, words):
    docs = spark.createDataFrame([(i, text(100 + i, words)) for i in range(40)], "doc_id long, text string")
    rank, short = P.ranks(docs), P.ranks(docs, window=P.SHORT)
    got = P.compare_edited(docs, rank, short=short).collect()
    assert len(got) == 40 and min(r.near_edited for r in got) > 0.2
    assert sorted(r.near_next for r in got)[20] < 0.1


def test_short_windows_equal_brute_force():
    rank = np.random.default_rng(1).permutation(P.LEVELS)
    raw = text(5, 12).encode()
    w, full = P.SHORT, int(P.WEIGHT[P.SHORT])
    level = [(full - sum(int(P.WEIGHT[raw[i : i + w].count(b)]) for b in set(raw[i : i + w]))) * (P.LEVELS - 1) // full for i in range(len(raw) - w + 1)]
    score = {}
    for j in range(len(level) - w + 1):
        i = min((rank[level[i]], i) for i in range(j, j + w) if level[i] >= P.FLAT_LEVEL)[1]
        score[i] = score.get(i, 0) + 1
    want = list(dict.fromkeys(raw[i : i + w] for i in sorted(score) if score[i] >= P.SHORT_POPULAR))
    assert P.features([b"x" * 300, raw, b"", b"abcdef"], rank, rank) == [[b"x" * 300], want, [], [b"abcd", b"bcde", b"cdef"]]
