"""Registered queries of this subpackage, each over its whole tables, and the SQL of those that SQL can state."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.llm import bpe, chosen_path, fill_middle, fingerprints, language_id, line_runs, lm_score, mixing, oracle, quality_knn, quality_rules, secret_scan, substring_dedup, vector_trie
from lotwise.llm.common import documents, fold_of, labels
from lotwise.session import materialise

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.read_ranks(public_tokenizers.path(VOCABULARY))
    rows = bpe.decode(bpe.encode(documents(spark, sf_dir), ranks, public_tokenizers.PATTERN), ranks)
    return rows.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest_columns(secret_scan.scan(documents(spark, sf_dir)))


#: Domains of the labelled documents and their shares of all tokens.
TARGETS = {"clean": 0.9, "poor": 0.07, "toxic": 0.03}


def domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "poor").when(F.col("quality") == 1, "clean")
    return labels(spark, sf_dir).select("doc_id", name.alias("domain"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "source", "text")
    classes = mixing.classifier(docs, domains(spark, sf_dir))
    members = materialise(mixing.memberships(docs, classes).drop("text"), "members")
    rates = mixing.fit(members, classes, TARGETS)
    rated = mixing.with_rates(members, rates)
    shares = [F.get("posterior", F.lit(i)).alias(f"p_{d}") for i, d in enumerate(classes.domains)]
    return rated.select("doc_id", "source", "n_tokens", *shares, "rate", "copies", F.lit(rates.residual).alias("residual"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    ratios = quality_rules.model(docs, labels(spark, sf_dir).where("quality = 1 and toxic = 0"))
    return quality_rules.rules(docs, ratios).select("doc_id", *quality_rules.ADDED)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = fold_of("doc_id", 4) == 2
    model = language_id.fit(docs.where(~held_out))
    return language_id.predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = fold_of("doc_id", 7)
    docs = documents(spark, sf_dir).withColumn("trained", fold != 2)
    return lm_score.score(docs, "trained").withColumn("held_out", fold == 2).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = fold_of("doc_id", 5) == 0
    model = quality_knn.fit(docs, labels(spark, sf_dir).where(~held_out))
    scored = quality_knn.score(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return fingerprints.compare_edited(docs, fingerprints.ranks(docs), short=fingerprints.ranks(docs, window=fingerprints.SHORT))


def op9_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.near_duplicates(documents(spark, sf_dir)).drop("v")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    rows = substring_dedup.without_repeats(docs, substring_dedup.repeated_spans(docs))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fill_middle.transform(documents(spark, sf_dir).select("doc_id", "text"))
    back = fill_middle.restored(F.col("output"), F.col("form"))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


def op12_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_runs.without_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op13_vector_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_trie.variants(vector_trie.words(documents(spark, sf_dir)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_secret_scan": op2_secret_scan,
    "op3_mixing": op3_mixing,
    "op4_quality_rules": op4_quality_rules,
    "op5_language_id": op5_language_id,
    "op6_lm_score": op6_lm_score,
    "op7_quality_knn": op7_quality_knn,
    "op8_fingerprints": op8_fingerprints,
    "op9_chosen_path": op9_chosen_path,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_fill_middle": op11_fill_middle,
    "op12_line_runs": op12_line_runs,
    "op13_vector_trie": op13_vector_trie,
}
#: Ids, hashed n-grams, fitted models and digests are beyond SQL; tests/llm holds these queries' operators against brute force.
ORACLE: dict[str, str] = {
    "op2_secret_scan": oracle.secret_scan(),
    "op9_chosen_path": oracle.near_duplicates(),
    "op10_substring_dedup": oracle.without_repeats(),
    "op11_fill_middle": oracle.fill_middle(),
    "op12_line_runs": oracle.without_repeated_lines(),
}
