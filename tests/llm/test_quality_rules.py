import math
from collections import Counter

import pytest
import regex
import xxhash

from lotwise.llm import quality_rules as Q

WHITE = b" \t\n\x0b\x0c\r"


def base(text):
    raw = (text or "").encode()
    words = [w.decode() for w in raw.split()]
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = Counter(grams)
    covered = {j for i, g in enumerate(grams) if seen[g] > 1 for j in (i, i + 1, i + 2)}
    n = len(words)
    return n, sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n


def spark_hash(*words):
    h = 42
    for w in words:
        h = xxhash.xxh64_intdigest(w.encode(), seed=h)
    return (h - (1 << 64) if h >= 1 << 63 else h) % Q.BUCKETS


def buckets(text):
    tokens = regex.findall(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\x20\x09-\x0D]+", text or "")
    return [spark_hash(t) for t in tokens] + [spark_hash(t, tokens[i + 1] if i + 1 < len(tokens) else "") for i, t in enumerate(tokens)]


TEXTS = [
    None, "", "  \t\n", "one", "a b c d", "a b c a b c x", "x y z\nx y z\n\n \nx y z", "é ü# *a* <b>|c &d\x0b e\x0cf", "w " * 5000,
    " ".join(f"word{i % 60} and" for i in range(300)), " ".join(f"word{i}" for i in range(80)), "a b c d",
    " ".join(f"good{i} text" for i in range(70)), " ".join(f"bad{i}*** ###" for i in range(70)),
]


def test_counts_and_ratios_equal_brute_force(spark):
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS)] + [(4, TEXTS[4], None), (None, "no id", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    trusted = spark.createDataFrame([(10,), (12,), (12,), (None,), (77,)], "doc_id long")
    raw, target = Counter(), Counter()
    for i, t, _ in rows:
        raw.update(buckets(t))
        if i in (10, 12):
            target.update(buckets(t))
    n, m = sum(raw.values()), sum(target.values())
    got = Q.rules(docs, Q.model(docs, trusted)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(r.text), r.text
        b = buckets(r.text)
        want = sum(math.log((target[x] + 1) / (m + Q.BUCKETS)) - math.log((raw[x] + 1) / (n + Q.BUCKETS)) for x in b) / len(b) if b else 0
        assert r.llr == pytest.approx(want, abs=1e-9)
        assert r.kept == (not r.base_failed and r.llr >= Q.THRESHOLD)


def test_nothing_trusted_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "word " * 60)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long")
    assert [r.llr for r in Q.rules(docs, Q.model(docs, none)).collect()] == [0.0]
    empty = docs.where("false")
    assert Q.rules(empty, Q.model(empty, none)).collect() == []
