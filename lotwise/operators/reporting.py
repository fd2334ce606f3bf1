"""Aggregates of the report and of the method page. Each is one pass with partial aggregation."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwise import catalog as K
from lotwise.functions.numeric import half_even
from lotwise.operators.order_stats import medians


def distinct_blocks(df: DataFrame) -> DataFrame:
    return df.agg(F.count_distinct("block_id").alias("n_blocks"))


def score_summary(df: DataFrame, scores: Sequence[str] = ("CPI_v3", "CPI_technique")) -> DataFrame:
    """Mean, sample std, min and max of each score over valid rows, one row per score."""
    stats = df.where("is_valid").agg(
        *[f(s).alias(f"{n}_{s}") for s in scores for n, f in (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))]
    )
    rows = [
        F.struct(F.lit(s).alias("score"), *[F.col(f"{n}_{s}").alias(f"score_{n}") for n in ("mean", "std", "min", "max")])
        for s in scores
    ]
    return stats.select(F.inline(F.array(*rows)))


def _rows(counts: DataFrame, names: Sequence[str], label: str) -> DataFrame:
    return counts.select(F.inline(F.array(*[F.struct(F.lit(n).alias(label), F.col(n).alias("n")) for n in names])))


def zone_distribution(df: DataFrame, column: str = "zone_plu") -> DataFrame:
    z = F.col(column)
    up = F.upper(z)
    counts = df.agg(
        F.count_if(up.startswith("U")).alias("U"),
        F.count_if(up.startswith("AU")).alias("AU"),
        F.count_if(z == "N").alias("N"),
        F.count_if(z == "A").alias("A"),
        F.count_if(z == K.UNKNOWN_ZONE).alias(K.UNKNOWN_ZONE),
    )
    return _rows(counts, ["U", "AU", "N", "A", K.UNKNOWN_ZONE], "zone")


def layer_zone_counts(layer: DataFrame) -> DataFrame:
    """Zone families of a zoning layer, by the first non-null of the known column names."""
    named = [c for c in layer.columns if c.lower() in K.ZONE_COLUMNS[:-1]]
    value = F.coalesce(*[F.col(c) for c in named]) if named else F.lit(None).cast("string")
    z = F.translate(F.upper(F.trim(F.coalesce(value, F.lit("")))), " ", "")
    au = z.startswith("AU")
    counts = layer.agg(
        F.count_if(z.startswith("U")).alias("U"),
        F.count_if(au).alias("AU"),
        F.count_if(z.startswith("N")).alias("N"),
        F.count_if(z.startswith("A") & ~au).alias("A"),
    )
    return _rows(counts, ["U", "AU", "N", "A"], "zone")


def shape_coverage_metrics(df: DataFrame, hazard_columns: Sequence[str] = ("brgm_argiles_flag", "brgm_mvt_terrain_flag")) -> DataFrame:
    med = medians(df, ["compactness_ratio", "ces_residuel"])
    return df.agg(
        F.count_if(F.col("compactness_ratio") < 0.20).alias("n_elongated"),
        F.count_if(F.col("emprise_residuelle_m2") >= K.MIN_FOOTPRINT_M2).alias("n_viable_80m2"),
        F.count_if(F.col("ces_existant") > 0.80).alias("n_saturated"),
        *[F.count_if(F.col(h)).alias(f"n_{h}") for h in hazard_columns],
    ).withColumns(
        {
            "median_compactness": F.lit(med["compactness_ratio"]).cast("double"),
            "median_residuel": F.lit(med["ces_residuel"]).cast("double"),
        }
    )


def label_distribution(df: DataFrame, column: str, labels: Sequence[str]) -> DataFrame:
    """Count and share of every label of the ladder, in its order; the share is over all rows."""
    counts = df.agg(*[F.count_if(F.col(column) == l).alias(f"c{i}") for i, l in enumerate(labels)], F.count(F.lit(1)).alias("t"))
    pct = lambda i: F.col(f"c{i}") * 100.0 / F.greatest(F.col("t"), F.lit(1))
    return counts.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(i).alias("position"), F.lit(l).alias("label"), F.col(f"c{i}").alias("n"), pct(i).alias("pct"))
                    for i, l in enumerate(labels)
                ]
            )
        )
    )


def corr_matrix(df: DataFrame, columns: Sequence[str], digits: int = 3) -> DataFrame:
    """Pairwise-complete Pearson correlations; all pairs of columns in one aggregate."""
    pairs = list(combinations(columns, 2))
    row = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"p{i}") for i, (a, b) in enumerate(pairs)])
    out = [
        F.struct(F.lit(a).alias("score_a"), F.lit(b).alias("score_b"), half_even(F.col(f"p{i}"), digits).alias("pearson"))
        for i, (a, b) in enumerate(pairs)
    ]
    return row.select(F.inline(F.array(*out)))


def shap_importance(df: DataFrame, features: Sequence[str] = tuple(K.FEATURES), prefix: str = "shap_") -> DataFrame:
    """Mean absolute contribution per feature, with its theme; the wide row never becomes long."""
    group = {f: g for g, fs in K.FEATURE_GROUPS.items() for f in fs}
    row = df.agg(*[F.avg(F.abs(prefix + f)).alias(f) for f in features])
    items = [F.struct(F.lit(f).alias("feature"), F.lit(group.get(f, "?")).alias("groupe"), F.col(f).alias("mean_abs_shap")) for f in features]
    return row.select(F.inline(F.array(*items)))


def shap_group_importance(importance: DataFrame) -> DataFrame:
    return importance.groupBy("groupe").agg(F.sum("mean_abs_shap").alias("mean_abs_shap"))


def histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """Counts of equal bins between the minimum and the maximum. A bin holds its lower edge, the last one the maximum as well."""
    low, high = df.agg(F.min(column), F.max(column)).first()
    known = df.where(F.col(column).isNotNull())
    at = F.lit(1)
    if low is not None and low != high:
        low, width = float(low), float(high) - float(low)
        for k in range(1, bins):  # against the edges themselves: a quotient rounds values on an edge to either side
            at = at + (F.col(column) >= low + k * width / bins).cast("int")
    return known.groupBy(at.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def report_row(df: DataFrame, tau: float | None = None, feature_names: Sequence[str] = tuple(K.FEATURES)) -> DataFrame:
    """The summary report as one nested row."""
    valid = lambda c: F.when(F.col("is_valid"), F.col(c))

    def stats(c: str) -> Column:
        return F.struct(
            F.avg(valid(c)).alias("mean"), F.stddev_samp(valid(c)).alias("std"), F.min(valid(c)).alias("min"), F.max(valid(c)).alias("max")
        ).alias(f"{c.lower()}_stats")

    labelled = F.col("is_valid") & (F.col("proxy_label") != -1)
    med = medians(df, ["compactness_ratio", "ces_residuel"])
    up = F.upper("zone_plu")
    return df.agg(
        F.count(F.lit(1)).alias("n_total"),
        F.count_if("is_valid").alias("n_valid"),
        F.count_if(labelled).alias("n_labeled"),
        F.count_if(labelled & (F.col("proxy_label") == 1)).alias("n_pos"),
        F.count_if(labelled & (F.col("proxy_label") == 0)).alias("n_neg"),
        F.count_distinct("block_id").alias("n_blocks"),
        stats("CPI_v3"),
        stats("CPI_technique"),
        F.struct(
            F.count_if(up.startswith("U")).alias("U"), F.count_if(up.startswith("AU")).alias("AU"),
            F.count_if(F.col("zone_plu") == "N").alias("N"), F.count_if(F.col("zone_plu") == "A").alias("A"),
            F.count_if(F.col("zone_plu") == K.UNKNOWN_ZONE).alias(K.UNKNOWN_ZONE),
        ).alias("plu_distribution"),
        F.struct(
            F.lit(med["compactness_ratio"]).cast("double").alias("median_compactness"),
            F.count_if(F.col("compactness_ratio") < 0.20).alias("n_elongated"),
        ).alias("shape_metrics"),
        F.struct(
            F.lit(med["ces_residuel"]).cast("double").alias("median_residuel"),
            F.count_if(F.col("emprise_residuelle_m2") >= K.MIN_FOOTPRINT_M2).alias("n_viable_80m2"),
            F.count_if(F.col("ces_existant") > 0.80).alias("n_saturated"),
        ).alias("ces_metrics"),
    ).withColumns(
        {
            "version": F.lit("6.0"),
            "commune": F.lit(K.COMMUNE_CODE),
            "tau_softmin": F.lit(tau).cast("double"),
            "features": F.array(*[F.lit(f) for f in feature_names]),
        }
    )


