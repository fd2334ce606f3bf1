"""Rank consensus over several scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.functions.numeric import clip
from lotwise.functions.text import padded_id
from lotwise.operators.order_stats import average_rank, global_quantiles, value_positions


def external_score(df: DataFrame, scores: DataFrame, id_col: str, score: str, parcel_ref: str, key: str = "parcel_id") -> DataFrame:
    """Score of another approach by normalised id. One score per id: the greatest of repeated ids."""
    mapped = scores.groupBy(padded_id(F.col(id_col)).alias("_id")).agg(F.max(score).alias(score))
    ids = df.select(key, padded_id(F.col(parcel_ref)).alias("_id"))
    return ids.join(mapped.hint("merge"), "_id", "left").select(key, score)  # shuffled: far more than its file's size tells


def pct_ranks(df: DataFrame, scores: Sequence[str], key: str = "parcel_id") -> DataFrame:
    """Long table (key, score, value, pct_rank): average rank over ties as percent of the known values."""
    long = df.select(key, *[F.col(s).cast("double").alias(s) for s in scores]).unpivot(key, list(scores), "score", "value")
    long = long.where(F.col("value").isNotNull())
    places = value_positions(long, ["score"], "value").select(
        "score", "value", (average_rank() / F.col("total") * 100.0).alias("pct_rank")
    )
    return long.join(places, ["score", "value"])


def consensus(df: DataFrame, scores: Sequence[str], key: str = "parcel_id") -> DataFrame:
    """Mean of the known percent ranks, agreement among them and their number.

    A parcel without any score keeps a row with NULL consensus, full confidence and no approach, as the
    missing spread counts as zero.
    """
    merged = pct_ranks(df, scores, key).groupBy(key).agg(
        F.avg("pct_rank").alias("consensus_score"),
        F.stddev_samp("pct_rank").alias("_spread"),
        F.count(F.lit(1)).alias("n_approaches_used"),
    )
    raw = F.lit(1.0) - F.coalesce(F.col("_spread"), F.lit(0.0)) / 100.0
    return (
        df.select(key).join(merged, key, "left")
        .withColumn("_confidence", raw)
        .select(
            key, "consensus_score", clip(F.col("_confidence"), 0.0, 1.0).alias("consensus_confidence"),
            F.coalesce("n_approaches_used", F.lit(0)).cast("long").alias("n_approaches_used"), "_confidence",
        )
    )


def consensus_meta(merged: DataFrame, df: DataFrame, scores: Sequence[str]) -> DataFrame:
    """Summary row: approaches available, medians, numbers of high and low confidence."""
    q = global_quantiles(merged, {"s": ("consensus_score", [0.5]), "c": ("_confidence", [0.5])})
    known = df.agg(*[(F.count(s) > 0).cast("int").alias(s) for s in scores]).first()
    return merged.agg(
        F.count_if(F.col("_confidence") > 0.80).alias("high_conf"),
        F.count_if(F.col("_confidence") < 0.50).alias("low_conf"),
        F.count(F.lit(1)).alias("n_total"),
    ).select(
        F.lit(sum(known)).alias("available_count"),
        F.lit(q["s"][0]).cast("double").alias("median_consensus"),
        F.lit(q["c"][0]).cast("double").alias("median_confidence"),
        "high_conf", "low_conf", "n_total",
    )


def value_percentile(df: DataFrame, column: str, key: str = "parcel_id") -> DataFrame:
    """Share of rows strictly below each value; rows without a value stay in the denominator."""
    n = df.count()
    places = value_positions(df.select(column), [], column).select(
        F.col(column), (F.col("below") / F.lit(float(n))).alias("share_below")
    )
    return df.select(key, F.col(column).cast("double").alias(column)).join(places, column, "left").select(key, column, "share_below")
