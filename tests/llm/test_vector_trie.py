import random
import re
import zlib
from collections import Counter

from lotwise.llm import vector_trie as V
from lotwise.llm.queries import op13_vector_trie

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counted(rows, noise=199, min_chars=6, min_count=5):
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(UPPER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if noise and h % noise == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= min_chars and c >= min_count}


def neighbours(n):
    """By wildcards: words that agree but for one place, or after one letter has gone."""
    near = {w: set() for w in n}
    masks, shorter = {}, {}
    for w in n:
        for i in range(len(w)):
            masks.setdefault(w[:i] + "*" + w[i + 1 :], set()).add(w)
            shorter.setdefault(w[:i] + w[i + 1 :], set()).add(w)
    for group in masks.values():
        for w in group:
            near[w] |= group - {w}
    for w in n:
        for x in shorter.get(w, ()):
            near[w].add(x)
            near[x].add(w)
    return near


def brute(n, ratio=5):
    near, form = neighbours(n), {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()), key=repr)


def test_variants_equal_brute_force(spark):
    r = random.Random(5)
    stems = ["".join(r.choice("aeintrséüzx") for _ in range(r.randint(5, 9))) for _ in range(60)]
    n = {}
    for s in stems:
        n[s] = r.choice([5, 30, 200, 40_000])
        for _ in range(8):
            i = r.randrange(len(s))
            s = r.choice([s[:i] + s[i + 1 :], s[:i] + r.choice("aetqß") + s[i:], s[:i] + r.choice("aetqß") + s[i + 1 :]])
            n.setdefault(s, r.choice([5, 6, 25, 125, 1000, 5000]))
    n |= {"anagram" + "ab" * k: 5 for k in range(6)} | {"x" * k: 5 ** (k - 4) for k in range(6, 16)}
    rows = spark.createDataFrame(list(n.items()), "word string, n long")
    want = brute(n)
    assert any(x[1] for x in want) and any(x[1] and x[2] != x[1] for x in want)
    for limit in (None, 40, 3, 1):
        assert got(V.variants(rows, limit=limit)) == want
    assert got(V.variants(rows, ratio=2)) == brute(n, 2)
    pairs = {(x.word, x.other) for x in V.near_words(rows, 7).collect()}
    assert pairs == {(w, x) for w, others in neighbours(n).items() for x in others}


def test_a_leaf_with_many_words_is_dealt(spark):
    letters = "xzjq"  # all in the last group: one leaf
    r = random.Random(1)
    n = {"".join(r.choice(letters) for _ in range(7)): r.choice([5, 25, 99]) for _ in range(300)}
    assert len({V.vector(w) for w in n}) == 1
    rows = spark.createDataFrame(list(n.items()), "word string, n long")
    assert got(V.variants(rows, limit=20)) == brute(n)


def test_words_equal_brute_force(spark):
    r = random.Random(2)
    vocabulary = ["Wording", "Écoleé", "écoleé", "a×b÷cd", "short", "longerword" * 20, "sevenly", "abcdef"]
    rows = [(i, r.choice([" ", "1", "-\n"]).join(r.choice(vocabulary) for _ in range(40))) for i in range(200)]
    rows += [(None, "Wording " * 9), (None, None), (3, ""), (4, "abcdef " * 20_000)] + [(77, "again again thisword")] * 6
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, word int")
    for noise in (199, 3, 0):
        assert {x.word: x.n for x in V.words(docs, noise=noise).collect()} == counted(rows, noise)
    assert V.words(docs.where("false")).collect() == [] and got(V.variants(V.words(docs.where("false")))) == []


def test_query_over_the_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert got(op13_vector_trie(spark, sf)) == brute(counted(rows))
