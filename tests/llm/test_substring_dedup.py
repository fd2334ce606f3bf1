import random

from lotwise.llm import substring_dedup as D


def brute(rows, k):
    """Distinct (id, text) documents in order; which words of each are covered by a window seen before."""
    docs = sorted({(i, t or "") for i, t in rows}, key=lambda d: (d[0] is not None, d[0] or 0, version(d[1])))
    seen, out = set(), {}
    for d in docs:
        words, gone = d[1].encode().split(), set()
        for p in range(len(words) - k + 1):
            w = tuple(words[p : p + k])
            if w in seen:
                gone |= set(range(p, p + k))
            seen.add(w)
        out[d] = (len(words), len(gone), " ".join(w.decode() for p, w in enumerate(words) if p not in gone))
    return out


def version(text):
    import xxhash

    h = xxhash.xxh64_intdigest(text.encode(), seed=42)
    return (h - (1 << 64) if h >= 1 << 63 else h) % 32749


def run(spark, rows, k, **kw):
    docs = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, kept string")
    return D.without_repeats(docs, D.repeated_spans(docs, k=k, **kw)).collect()


def made(seed, n_docs, vocabulary):
    r = random.Random(seed)
    passages = [[r.choice(vocabulary) for _ in range(r.randint(3, 60))] for _ in range(6)]
    rows = []
    for i in range(n_docs):
        words = []
        for _ in range(r.randint(0, 4)):
            words += r.choice(passages) if r.random() < 0.6 else [r.choice(vocabulary) for _ in range(r.randint(1, 30))]
        rows.append((i, r.choice([" ", "\n", " \t"]).join(words)))
    return rows


def test_words_kept_equal_brute_force(spark):
    many = [f"w{i}" for i in range(500)]
    for seed, vocabulary in ((1, many), (2, ["a", "b"]), (3, ["x"])):
        rows = made(seed, 40, vocabulary)
        rows += [(100, None), (101, ""), (102, "one"), (7, rows[8][1]), (9, rows[9][1]), (None, rows[3][1]), (103, "é " * 3000), (104, rows[2][1])]
        for k in (20, 5):
            want = brute(rows, k)
            got = run(spark, rows, k)
            assert len(got) == len(rows)
            have = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got), key=repr)
            assert have == sorted(((i, *want[i, t or ""]) for i, t in rows), key=repr)


def test_a_full_sieve_changes_nothing(spark):
    rows = made(4, 30, [f"w{i}" for i in range(90)])
    assert sorted(run(spark, rows, 6, sieve_bits=8)) == sorted(run(spark, rows, 6))


def test_spans_name_their_source(spark):
    passage = " ".join(f"p{i}" for i in range(50))
    docs = spark.createDataFrame([(1, "a b " + passage), (2, passage + " z"), (3, "q " + passage)], "doc_id long, text string")
    spans = sorted((r.key, r.start, r.stop, r.source, r.source_pos) for r in D.repeated_spans(docs).collect())
    assert spans == [(2, 0, 50, 1, 2), (3, 1, 51, 1, 2)]


def test_no_rows(spark):
    assert run(spark, [], 20) == []


def test_frequent_anchors_change_nothing(spark, monkeypatch):
    rows = made(5, 40, [f"w{i}" for i in range(60)])
    want = sorted(run(spark, rows, 20), key=repr)
    monkeypatch.setattr(D, "HOT", 10**9)  # every anchor has more than this share of the places: edges go one by one
    assert sorted(run(spark, rows, 20), key=repr) == want


def test_neighbouring_windows_are_moved_as_one_row(spark):
    passage = " ".join(f"p{i}" for i in range(2000))
    docs = spark.createDataFrame([(i, passage) for i in range(4)], "doc_id long, text string").repartition(4, "doc_id")
    rows = D.keyed(docs, "doc_id", "text")
    sieve = D.Sieve.of(D.repeated_anchors(rows, 20), 20)
    moved = D.edges(rows, sieve, D.np.zeros(0, D.np.uint64), 20)
    assert moved.count() < 4 * 1981 / 3
    assert sorted((r.key, r.start, r.stop, r.source, r.source_pos) for r in D.repeated_spans(docs).collect()) == [(i, 0, 2000, 0, 0) for i in (1, 2, 3)]


def test_spans_end_where_the_source_forks(spark):
    a = [f"p{i}" for i in range(60)]
    docs = [(1, a), (2, a), (3, ["q"] + a[30:] + ["r"]), (4, ["q"] + a[30:] + ["s"])]  # docs 3 and 4 come to the middle of doc 1 by another word
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string").repartition(4, "doc_id")
    spans = sorted((r.key, r.start, r.stop, r.source, r.source_pos) for r in D.repeated_spans(df, k=5).collect())
    assert [s for s in spans if s[0] == 2] == [(2, 0, 34, 1, 0), (2, 30, 60, 1, 30)]
