import hashlib
import random
import re
from collections import defaultdict

from lotwise.llm import line_runs as R

ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_chars=40, min_docs=5):
    """Per row: lines, dropped lines, text kept."""
    key = lambda x: re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", x).translate(ASCII_LOWER)
    holders = defaultdict(set)
    for n, (i, t) in enumerate(rows):
        for line in (t or "").split("\n"):
            holders[key(line)].add((n, i))
    rank = lambda i: float("-inf") if i is None else i
    drop = {k: max(rank(i) for _, i in h) for k, h in holders.items() if len(k) >= min_chars and len(h) >= min_docs}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if key(x) not in drop or rank(i) == drop[key(x)]]
        out.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return out


def run(spark, rows, **kw):
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, kept string, v_ int")
    done = R.without_repeats(docs, **kw)
    assert set(done.columns) == {"doc_id", "text", "v_", *R.ADDED}
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in done.collect()), key=repr)


def made(seed, n):
    r = random.Random(seed)
    common = [f"Common Line number {i} of a text, É long enough to count" for i in range(12)] + ["é" * 39, "é" * 40, "short", "", "x" * 40, "X" * 40 + " \t"]
    rows = []
    for i in range(n):
        lines = [r.choice(common) if r.random() < 0.5 else f"own line {r.random()} with some more words in it" for _ in range(r.randint(0, 9))]
        lines = [r.choice(["", " ", "\t\x0b"]) + (x.upper() if r.random() < 0.2 else x) + r.choice(["", " ", "\r"]) for x in lines]
        rows.append((i * 3 % 97, "\n".join(lines)))
    return rows


def test_equals_brute_force(spark):
    rows = made(1, 60) + [(500, None), (501, ""), (502, "\n\n"), (None, made(2, 9)[8][1]), (None, "x" * 40), (7, "x" * 40), (7, "x" * 40), (8, ("a line that is in this text very many times\n") * 4000)]
    rows += [(i, "only here and in a few others, this line is") for i in (600, 601, 602, 603)]
    rows += [(None, "in rows without an id only, but in five of those")] * 5
    want = sorted(brute(rows), key=repr)
    assert run(spark, rows) == want
    assert run(spark, rows, batches=1) == want
    assert run(spark, rows, batches=23, sieve_bits=8) == want
    assert run(spark, rows, min_chars=1, min_docs=2) == sorted(brute(rows, 1, 2), key=repr)


def test_keys_beyond_the_dictionary(spark, monkeypatch):
    rows = made(3, 80)
    monkeypatch.setattr(R, "HOT", 1)  # no key has more than all pairs: everything goes by the join
    assert run(spark, rows) == sorted(brute(rows), key=repr)


def test_runs_are_merged_by_level(spark):
    index = R.LineRuns(spark, fanout=2)
    for batch in range(5):
        rows = [(h, h, 1, 100 - batch) for h in range(batch, batch + 3)]
        index.add(spark.createDataFrame(rows, "a long, b long, docs long, last long"))
    assert [len(level) for level in index.levels] == [1, 0, 1]
    for run_ in index.runs():
        hashes = [r.a for r in spark.table(run_).collect()]
        assert len(hashes) == len(set(hashes))
    got = {r.a: (r.docs, r.keeper) for r in index.merged().collect()}
    assert got == {h: (sum(b <= h < b + 3 for b in range(5)), 100 - min(b for b in range(5) if b <= h < b + 3)) for h in range(7)}
    index.drop()


def test_no_rows(spark):
    assert run(spark, []) == []


def test_query_over_the_table(spark, sf):
    from lotwise.llm.queries import op12_line_runs

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in op12_line_runs(spark, sf).collect()}
    assert got == {i: (n, d, hashlib.sha256(k.encode()).hexdigest()) for i, n, d, k in brute(rows)}
    assert any(d for _, d, _ in got.values())


def test_no_task_needs_two_python_workers(spark):
    df = spark.createDataFrame([(i, f"text {i}\n" + "a line of more than forty characters, in all of them") for i in range(9)], "doc_id long, text string")
    plan = R.without_repeats(df)._jdf.queryExecution().optimizedPlan().toString()
    clean, other = plan.split("\n:- ")[-1].split("\n+- ", 1)  # the sides of the union
    assert plan.lstrip().startswith("Union") and clean.count("ArrowEvalPython") == 1
    assert other.split("Join", 1)[0].count("ArrowEvalPython") == 1 and other.split("Join", 1)[1].count("ArrowEvalPython") <= 1
