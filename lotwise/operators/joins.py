"""Key joins. Where the original attached results by row position, every join here is by ``parcel_id``.

Both sides grow with the input, and Spark's estimate of a few columns of a compressed file is far too small; so the joins ask for a
shuffle, as a table broadcast by that estimate would be built in the driver's memory.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COMPARED = ("CPI_technique", "CPI_ML_v3", "cluster_score", "consensus_score", "consensus_confidence")


def align_scores(df: DataFrame, scores: DataFrame, column: str, key: str = "parcel_id") -> DataFrame:
    return df.join(scores.select(key, column).hint("merge"), key, "left")


def attach_features(base: DataFrame, families: Sequence[DataFrame], key: str = "parcel_id") -> DataFrame:
    """N-way left join of feature families; equal partitioning on the key is reused from join to join."""
    return reduce(lambda left, right: left.join(right.hint("merge"), key, "left"), families, base)


def attach_intervals(df: DataFrame, intervals: DataFrame, key: str = "parcel_id") -> DataFrame:
    return df.join(intervals.select(key, "cpi_ml_ci_low", "cpi_ml_ci_high", "cpi_ml_std").hint("merge"), key, "left")


def geometry_join(features: DataFrame, geometry: DataFrame, key: str = "parcel_id") -> DataFrame:
    """Inner join; columns that both sides have are taken from the features."""
    extra = [c for c in geometry.columns if c == key or c not in features.columns]
    return features.join(geometry.select(*extra).hint("merge"), key)


def semi_join_ids(df: DataFrame, ids: DataFrame, key: str = "parcel_id") -> DataFrame:
    return df.join(ids.select(key).hint("merge"), key, "left_semi")


def compare_pairs(df: DataFrame, pairs: DataFrame, columns: Sequence[str] = COMPARED, key: str = "parcel_id") -> DataFrame:
    """Requested pairs (``id_a``, ``id_b``) side by side: deltas, winner (a draw goes to B) and margin."""
    a = df.select(F.col(key).alias("id_a"), *[F.col(c).alias(f"a_{c}") for c in columns])
    b = df.select(F.col(key).alias("id_b"), *[F.col(c).alias(f"b_{c}") for c in columns])
    both = pairs.where(F.col("id_a") != F.col("id_b")).hint("merge").join(a, "id_a").hint("merge").join(b, "id_b")
    lead_a, lead_b = F.col("a_CPI_technique"), F.col("b_CPI_technique")
    return both.select(
        "id_a", "id_b",
        *[(F.col(f"a_{c}") - F.col(f"b_{c}")).alias(f"delta_{c}") for c in columns],
        F.when(lead_a > lead_b, F.col("id_a")).otherwise(F.col("id_b")).alias("winner"),
        F.abs(lead_a - lead_b).alias("margin"),
    )
