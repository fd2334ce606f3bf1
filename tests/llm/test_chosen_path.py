import random

import pytest
from pyspark.sql import functions as F

from lotwise.llm import chosen_path as C


def shingles(text, size):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(zip(*(words[i:] for i in range(size)))) if len(words) >= size else frozenset([tuple(words)])


def brute(rows, size=2, percent=80):
    sets = [shingles(t, size) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = root(i)
        least[r] = min((x for x in (least.get(r), d) if x is not None), default=None)
    return sorted(((d, len(sets[i]), least[root(i)], d == least[root(i)]) for i, (d, _) in enumerate(rows)), key=repr)


def family(r, base, n, edits):
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(r.randint(0, edits)):
            words[r.randrange(len(words))] = f"e{r.randrange(10**6)}"
        out.append(" ".join(words))
    return out


def run(spark, rows, **kw):
    docs = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, kept string")
    return sorted((tuple(r) for r in C.near_duplicates(docs, **kw).drop("v").collect()), key=repr)


@pytest.mark.parametrize("small", [32, 4])
def test_components_equal_brute_force(spark, monkeypatch, small):
    monkeypatch.setattr(C, "SMALL", small)
    monkeypatch.setattr(C, "BLOCK", 5)
    r = random.Random(small)
    texts = []
    for _ in range(6):
        base = [f"w{r.randrange(3000)}" for _ in range(r.randint(5, 90))]
        texts += family(r, base, r.randint(1, 25), max(1, len(base) // 9))
    texts += [texts[0]] * 7 + [texts[3].upper(), None, "", " \n", "one", "One", "two words", "a a a a a a", "x " * 4000]
    rows = list(enumerate(texts)) + [(2, texts[30]), (1, texts[1]), (None, texts[9]), (None, "lone text without id")]
    assert run(spark, rows) == brute(rows)


def test_other_shingles_and_no_rows(spark):
    r = random.Random(3)
    rows = list(enumerate(family(r, [f"w{i}" for i in range(60)], 12, 3)))
    assert run(spark, rows, size=5, percent=60) == brute(rows, 5, 60)
    assert run(spark, []) == []


def test_long_chains_are_one_component(spark):
    links = [(bytes([i]) * 16, bytes([i + 1]) * 16) for i in range(60)] + [(bytes([100]) * 16, bytes([101]) * 16)]
    got = {bytes(r.cls)[0]: bytes(r.label)[0] for r in C.components(spark.createDataFrame(links, "a binary, b binary")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def test_links_within_a_component_are_read_once(spark, monkeypatch):
    r = random.Random(8)
    names = [i.to_bytes(2, "big") * 8 for i in r.sample(range(60000), 300)]
    links = [(names[i], names[i + 1]) for i in range(299) if i != 150] + [(a, b) for a in names[:40] for b in names[:40] if a < b]
    written = []
    real = C.materialise
    monkeypatch.setattr(C, "materialise", lambda df, label: (out := real(df, label), written.append(out.count()) if label == "links" else None)[0])
    got = {bytes(x.cls): bytes(x.label) for x in C.components(spark.createDataFrame(links, "a binary, b binary")).collect()}
    assert got == {n: min(names[:151] if i <= 150 else names[151:]) for i, n in enumerate(names)}
    assert written[-1] == 0 and sum(written[1:]) < written[0] / 4


def test_a_block_gives_no_more_links_than_join_its_components(spark, monkeypatch):
    monkeypatch.setattr(C, "SMALL", 2)
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(base[:i] + [f"e{i}"] + base[i + 1 :])) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one = C.sketches(docs, "doc_id", "text", 2).where("cls is not null")
    classes = one.select("cls", F.col("id").alias("rep"), "tokens", "sig")
    sets = spark.createDataFrame([(x, s.tobytes()) for s in C.shingle_sets([t for _, t in rows], C.WordHashes(), 2) for x in [C.digest(s)]], "cls binary, hashes binary")
    large = classes.select(F.lit(1).cast("long").alias("path"), "cls")
    labels = spark.createDataFrame([], "cls binary, label binary")
    links = [(bytes(x.a), bytes(x.b)) for x in C.confirmed_in_blocks(large, labels, classes, sets, 80).collect()]
    assert len(links) == 59 and {c for x in links for c in x} == {bytes(x.cls) for x in classes.collect()}


def test_one_of_each_group_stays(spark):
    r = random.Random(5)
    rows = list(enumerate(family(r, [f"w{i}" for i in range(200)], 6, 2))) + [(20, "a lone text of some words"), (20, "a lone text of some words"), (21, None), (None, "x y")]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, v string")
    got = C.one_of_each(docs).collect()
    assert sorted((repr(x.doc_id), x.v) for x in got) == [("0", "clash"), ("20", "clash"), ("21", "clash"), ("None", "clash")]
