import random

import numpy as np

from lotwise.llm import language_id, quality_knn

WORDS = {"aa": "the of and thing other", "bb": "der und nicht schön über", "cc": "le être où ça français"}


def sentence(lang, seed, n=40):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS[lang].split()) for _ in range(n))


def test_languages_are_learned(spark):
    rows = [(i, sentence(x, i), x, "clash") for i, x in enumerate(["aa", "bb", "cc"] * 8)]
    rows += [(90, None, "aa", None), (91, "", "bb", None), (92, "123 !!", "cc", None), (93, sentence("bb", 1), None, None), (None, sentence("aa", 5), "aa", None)]
    rows += [(94, sentence("cc", 7, 60_000), None, None), (0, rows[0][1], "aa", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = language_id.predict(docs, language_id.fit(docs)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert {by[i].lang_pred for i in (90, 91, 92)} == {"und"} and by[90].score == 0
    assert by[93].lang_pred == "bb" and by[94].lang_pred == "cc" and by[None].lang_pred == "aa"
    assert all(0 <= r.score <= 1 for r in got) and all(by[i].lang_pred == rows[i][2] for i in range(24))


def test_log_probabilities_equal_brute_force(spark):
    texts = ["ab ba", "Ab!c"]
    docs = spark.createDataFrame([(0, texts[0], "x"), (1, texts[1], "y")], "doc_id long, text string, lang string")
    m = language_id.fit(docs, bits=6, max_n=2)
    counts = np.zeros((2, 64))
    for i, t in enumerate(["ab ba", "ab c"]):
        for n in (1, 2):
            for k in range(len(t) - n + 1):
                counts[i, language_id.grams([t[k : k + n]], 6, n)[n - 1][0]] += 1
    assert np.allclose(m.table, np.log((counts + 0.5) / (counts.sum(1, keepdims=True) + 32)))


def test_nothing_learned_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    m = language_id.fit(docs)
    assert [(r.lang_pred, r.score) for r in language_id.predict(docs, m).collect()] == [("und", 0.0)]
    assert language_id.predict(docs.where("false"), m).collect() == []
    labelled = spark.createDataFrame([], "doc_id long, quality int")
    model = quality_knn.fit(docs, labelled)
    assert [r.score for r in quality_knn.score(docs, model).collect()] == [0.5]
    assert quality_knn.score(docs.where("false"), model).collect() == []


def test_neighbours_vote_like_brute_force(spark):
    rows = [(i, sentence("aa", i) if i % 2 else sentence("bb", i).upper() + "!!", "clash") for i in range(60)]
    rows += [(100, None, None), (101, "", None), (102, "x", None), (103, sentence("aa", 3, 50_000), None), (1, rows[1][1], None), (None, "no id", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labelled = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(1, 0), (2, None), (None, 1)], "doc_id long, quality int")
    m = quality_knn.fit(docs, labelled, per_class=15, dimensions=8, neighbours=5)
    assert len(m.labels) == 30 and m.labels.mean() == 0.5
    got = {r.doc_id: r.score for r in quality_knn.score(docs, m).collect()}
    assert len(got) == len(rows) - 1
    assert got[100] == got[101] == got[102] == 0.5
    assert got[103] > 0.9 and all((got[i] > 0.5) == bool(i % 2) for i in range(60))
    for i, t, _ in rows[:10]:
        v = quality_knn.unit(quality_knn.unit(quality_knn.counts_of([t]) * m.rarity) @ m.directions)[0]
        near = sorted(((float(v @ w), y) for w, y in zip(m.vectors, m.labels)), reverse=True)[:5]
        assert abs(got[i] - sum(max(c, 0) ** 4 * y for c, y in near) / sum(max(c, 0) ** 4 for c, _ in near)) < 1e-3
