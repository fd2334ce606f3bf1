import tiktoken

import corpus_pipeline as P
from lotwise.llm import bpe
from lotwise.llm import quality_rules as Q
from lotwise.llm.common import documents, labels
from lotwise.session import materialise

from .test_chosen_path import brute as brute_groups
from .test_quality_rules import base
from .test_secret_scan import brute as brute_spans


def masked(text):
    out, at = "", 0
    for _, start, stop in sorted(brute_spans(text), key=lambda s: s[1:]):
        if start >= at:
            out += text[at:start] + "[secret]"
        at = max(at, stop)
    return out + text[at:]


def test_every_stage_equals_brute_force(spark, sf):
    docs = documents(spark, sf)
    names = docs.columns
    before = docs.collect()
    toxic = {r.doc_id for r in labels(spark, sf).where("toxic = 1").collect()}
    poor = {r.doc_id for r in labels(spark, sf).where("quality = 0").collect()}

    one = materialise(P.quality(spark, docs, sf), "one")
    kept = {r.doc_id for r in one.collect()}
    ok = {r.doc_id for r in before if not base(r.text)[5]}
    ratio = {r.doc_id: r.llr for r in Q.rules(docs, Q.model(docs, labels(spark, sf).where("quality = 1 and toxic = 0"))).collect()}
    assert one.columns == names and kept == {d for d in ok if ratio[d] >= Q.THRESHOLD}
    assert not kept & poor - toxic

    two = materialise(P.near_dedup(spark, one, sf), "two")
    want = [d for d, _, _, stays in brute_groups([(r.doc_id, r.text) for r in one.collect()], size=5) if stays]
    assert two.columns == names and sorted(r.doc_id for r in two.collect()) == sorted(want)

    three = materialise(P.secrets(spark, two, sf), "three")
    new = {r.doc_id: r for r in three.collect()}
    assert three.columns == names and len(new) == len(want)
    for r in two.collect():
        text = masked(r.text)
        assert new[r.doc_id].text == text and new[r.doc_id].n_chars == (r.n_chars if text == r.text else len(text))

    four = materialise(P.mix(spark, three, sf), "four")
    stays = {r.doc_id for r in four.collect()}
    labelled = {r.doc_id for r in labels(spark, sf).collect()}
    assert four.columns == names and stays <= set(new)
    assert len((labelled - toxic) & set(new) - stays) == 0 and len(stays & toxic) <= 0.2 * len(toxic)

    five = P.tokenize(spark, four, sf).collect()
    enc = tiktoken.Encoding("own", pat_str=P.public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(P.public_tokenizers.path(P.VOCABULARY)), special_tokens={})
    rows = sorted((r.doc_id, r.text) for r in four.collect())
    assert sorted((r.doc_id, bpe.unpack(bytes(r.ids)).tolist()) for r in five) == sorted((d, enc.encode_ordinary(t)) for d, t in rows)


def test_odd_rows_go_through_every_stage(spark, sf):
    good = " ".join(f"word{i} of{i} the{i} text{i}" for i in range(60))
    rows = [(1, good, "en", "s", 9, "x"), (1, good, "en", "s", 9, "x"), (2, None, None, None, None, None), (3, "", None, None, 0, None), (None, good[::-1] + " end", None, None, None, None)]
    clash = "spans kept rate copies llr tokens_ ratios_ keys_ words_ table_ logits_ id_ v_ rows_ row_ copy_".split()
    rows = [(*r[:5], *[r[5]] * len(clash)) for r in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in clash))
    left = docs
    for _, stage in P.STAGES[:-1]:
        left = materialise(stage(spark, left, sf), "odd")
        assert left.columns == docs.columns and {r[c] for r in left.where("doc_id = 1").collect() for c in clash} == {"x"}
    out = P.tokenize(spark, left, sf).collect()
    assert {r.doc_id for r in out} == {1, None}
    for _, stage in P.STAGES:
        assert stage(spark, docs.where("false"), sf).count() == 0
