import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from lotwise.llm import bpe

RANKS = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})


def run(spark, rows, **kw):
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, decoded string")
    return bpe.decode(bpe.encode(docs, RANKS, PATTERN, **kw), RANKS).collect()


def made(seed, n):
    r = random.Random(seed)
    bits = ["the", " a", "'re", "'", "\n", "  ", "   ", "\t", "12", "é", "中文", "!!", "'s", "x", " \n ", "😀", "　", "word"]
    return "".join(r.choice(bits) for _ in range(n))


def test_ids_equal_the_library_and_decode_back(spark, reference):
    texts = ["", "a", "Hello's  world\n\n  x", "\U000323b0\U00016ea7a", "z" * 3000, " " * 3000, "'re" * 999, "é😀x" * 900, *(made(i, 40 * i) for i in range(1, 30))]
    rows = [(i, t, "clash", None) for i, t in enumerate(texts)] + [(900, None, None, None), (None, "no id", None, None)]
    for kw in ({}, {"chunk": 64, "overlap": 16}):
        got = {r.doc_id: r for r in run(spark, rows, **kw)}
        assert len(got) == len(rows)
        for i, t, *_ in rows:
            want = reference.encode_ordinary(t or "")
            assert bpe.unpack(bytes(got[i].ids)).tolist() == want, (kw, t)
            assert got[i].n_tokens == len(want)
            assert bytes(got[i].decoded) == (t or "").encode()


def test_rows_that_repeat_are_each_encoded(spark):
    text = made(5, 400)
    got = run(spark, [(1, text, None, None)] * 3 + [(2, text, None, None)], chunk=128, overlap=32)
    assert sorted(r.doc_id for r in got) == [1, 1, 1, 2]
    assert len({hashlib.sha256(bytes(r.ids)).hexdigest() for r in got}) == 1


def test_no_rows_and_broken_ids(spark):
    assert run(spark, []) == []
    rows = spark.createDataFrame([(1, b"\x01\x00\x00"), (2, None), (3, b"\xff\xff\xff\xff"), (4, b"")], "k long, ids binary")
    assert {r.k: r.decoded for r in bpe.decode(rows, RANKS).collect()} == {1: None, 2: None, 3: None, 4: bytearray(b"")}
