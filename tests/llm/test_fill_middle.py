import hashlib
import re

import regex

from lotwise.llm import fill_middle as M
from lotwise.llm.queries import op11_fill_middle


def brute(doc_id, text, percent=100, spm=50, seed=7):
    text = text or ""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if text == "" or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= percent:
        return len(units), "plain", None, None, text
    if h[3] % 100 < spm:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


TEXTS = ["a\nb\nc\nd\ne", "\n", "\n\n\n", "one line", "é\n\U0001f600x\nü", "x<P>y\nz", "<", "<\n<S\n>M>\nS>\n<", "a\r\nb\r\n", "tail\n", "", None, "l\n" * 3000, "long " * 5000, "<p>\n<s>\n"]


def test_equals_brute_force_and_goes_back(spark):
    rows = [(i * 31 + j, t, "clash", j) for i, t in enumerate(TEXTS) for j in range(6)] + [(None, "a\nb\nc", "x", 0)] * 2 + [(5, "r\ns\n", None, 1)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, output string, text_ int")
    for percent, spm in ((100, 50), (40, 100), (0, 0)):
        done = M.transform(docs, percent=percent, spm_percent=spm)
        got = done.withColumn("back", M.restored(done["output"], done["form"])).collect()
        assert len(got) == len(rows) and set(done.columns) == {*docs.columns, *M.ADDED}
        for r in got:
            assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == brute(r.doc_id, r.text, percent, spm), (r.doc_id, r.text)
            assert r.back == (r.text or "")
        assert sorted(r.text_ for r in got) == sorted(x[3] for x in rows)
    assert M.transform(docs.where("false")).collect() == []


def test_slices_give_the_ends_of_one_match():
    line = regex.compile(f"({M.LINE})*")
    for text in ("ab\n" * 50, "x" * 100 + "\nyy", "\n" * 40, "", "no end"):
        whole = [m.end() for m in re.finditer(M.LINE, text)]
        for size in (1, 7, 1000):
            assert M.unit_ends(line, text, "\n", size).tolist() == whole
    assert len(M.unit_ends(line, "\n" * 6_000_000, "\n")) == 6_000_000  # more than the library keeps in one match


def test_query_over_the_table(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op11_fill_middle(spark, sf).collect()
    assert len(got) == len(docs)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for r in got:
        *first, out = brute(r.doc_id, docs[r.doc_id])
        assert (r.n, r.form, r.prefix_chars, r.middle_chars) == tuple(first)
        assert r.output_sha256 == sha(out) and r.restored_sha256 == sha(docs[r.doc_id] or "")
    assert {r.form for r in got} >= {"psm", "spm"}
