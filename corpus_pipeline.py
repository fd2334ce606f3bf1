"""From raw documents to token ids: quality rules, near-dedup, secret masking, mixing and byte-level BPE.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the one before it kept. All but the last return the columns
of ``documents``. Null and empty texts fail the quality rules; a null id is let through; columns of other names stay, but for
the last stage; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.llm import bpe, chosen_path, mixing, quality_rules, secret_scan
from lotwise.llm.common import col, documents, free_names, labels
from lotwise.session import materialise, ship_package

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: All tokens are to come from the clean domain: toxic documents get low rates, clean ones a rate of 1 or somewhat more.
TARGETS = {"clean": 1.0, "toxic": 0.0}


def _aside(docs: DataFrame, names: Iterable[str]) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with its columns of these names called otherwise, and how to call them back."""
    clash = [c for c in docs.columns if c.lower() in names]
    free = free_names(docs, *clash)
    return docs.withColumnsRenamed(dict(zip(clash, free))), dict(zip(free, clash))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep; trusted are those labelled as good and not toxic."""
    docs, back = _aside(docs, quality_rules.ADDED)
    ratios = quality_rules.model(docs, labels(spark, sf_dir).where("quality = 1 and toxic = 0"))
    judged = materialise(quality_rules.rules(docs, ratios), "judged")  # a filter on the rules themselves would work them out per word
    return judged.where("kept").select(*map(col, docs.columns)).withColumnsRenamed(back)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with a similarity of 0.8 or more over shingles of five words."""
    return chosen_path.one_of_each(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets masked, and ``n_chars`` of the new text."""
    docs, back = _aside(docs, ("spans",))
    scanned = secret_scan.scan(docs)
    masked = scanned.withColumn("text", F.when(F.col("text").isNotNull(), secret_scan.redacted(F.col("text"), F.col("spans"))))
    n_chars = F.when(F.size("spans") > 0, F.char_length("text")).otherwise(F.col("n_chars"))
    return masked.withColumn("n_chars", n_chars.cast(docs.schema["n_chars"].dataType)).drop("spans").withColumnsRenamed(back)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their rates say; the clean domain is to give all tokens, so a clean document has a rate of 1 or more."""
    docs, back = _aside(docs, mixing.ADDED)
    named = labels(spark, sf_dir).select("doc_id", F.when(F.col("toxic") == 1, "toxic").when(F.col("toxic") == 0, "clean").alias("domain"))
    classes = mixing.classifier(docs, named)
    members = mixing.memberships(docs, classes)
    rates = mixing.fit(materialise(members.select("n_tokens", "posterior"), "members"), classes, TARGETS)
    rated = mixing.with_rates(members, rates, text_col="text")
    (copy_,) = free_names(docs, "copy_")
    repeated = rated.select(*map(col, docs.columns), F.explode_outer(F.array_repeat(F.lit(1), F.col("copies").cast("int"))).alias(copy_))
    return repeated.where(F.col(copy_) == 1).drop(copy_).withColumnsRenamed(back)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The id, ``n_tokens`` and packed ``ids`` of each document."""
    ranks = bpe.read_ranks(public_tokenizers.path(VOCABULARY))
    return bpe.encode(docs, ranks, public_tokenizers.PATTERN)


STAGES = [("quality rules", quality), ("near-dedup", near_dedup), ("secret scan", secrets), ("mixing", mix), ("byte-level BPE", tokenize)]

#: The hashed ratios of the first stage, the rates of the fourth and the ids of the last are beyond SQL; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
