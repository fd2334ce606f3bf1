"""Screening queries over the scored table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lotwise import catalog as K
from lotwise.functions.numeric import half_even, ladder
from lotwise.functions.text import compact_id

ALL_LABELS = [label for _, label in K.LADDER_VIEWER]


def top_k(df: DataFrame, column: str, k: int, key: str = "parcel_id") -> DataFrame:
    """Greatest ``k`` values, ties by id; Spark keeps k rows per task and merges them."""
    return df.orderBy(F.col(column).desc_nulls_last(), F.col(key)).limit(k)


def ranked_top(df: DataFrame, column: str, k: int = 10, key: str = "parcel_id") -> DataFrame:
    best = top_k(df, column, k, key)  # the window below sees k rows only
    return best.withColumn("rang", F.row_number().over(W.orderBy(F.col(column).desc_nulls_last(), F.col(key))))


def passes(min_cpi, min_conf, max_slope, min_surface) -> Column:
    """The screen; unknown values fail."""
    return F.coalesce(
        (F.col("CPI_technique") >= min_cpi)
        & (F.col("consensus_confidence") >= min_conf)
        & (F.col("slope_p90") <= max_slope)
        & (F.col("surface_m2") >= min_surface)
        & F.col("is_valid"),
        F.lit(False),
    )


def screen(
    df: DataFrame, min_cpi=30.0, min_conf=0.5, max_slope=30.0, min_surface=100.0,
    labels: Sequence[str] = tuple(ALL_LABELS), explained_ids: DataFrame | None = None, key: str = "parcel_id",
) -> DataFrame:
    kept = df.where(passes(min_cpi, min_conf, max_slope, min_surface))
    kept = kept.withColumn("cat", ladder(F.col("CPI_technique"), K.LADDER_VIEWER, K.LABEL_MISSING)).where(F.col("cat").isin(*labels))
    return kept if explained_ids is None else kept.join(explained_ids.select(key), key, "left_semi")


def screen_parcels(df: DataFrame, limit: int | None = None, **thresholds) -> DataFrame:
    """All parcels that pass; with ``limit`` the best of them (a map draws ``K.SCREEN_LIMIT`` at most)."""
    kept = screen(df, **thresholds)
    return kept if limit is None else top_k(kept, "CPI_technique", limit)


def screen_profiles(df: DataFrame, profiles=tuple(K.PROFILES)) -> DataFrame:
    """The same screen under each named profile. One scan; a row is tagged with the profiles it passes."""
    tags = F.array_compact(F.array(*[F.when(passes(*t), F.lit(name)) for name, *t in profiles]))
    return (
        df.select("CPI_technique", F.explode(tags).alias("profile"))
        .groupBy("profile")
        .agg(F.count(F.lit(1)).alias("n"), F.avg("CPI_technique").alias("mean_cpi"), F.max("CPI_technique").alias("best_cpi"))
    )


def screen_kpis(df: DataFrame, explained_ids: DataFrame, key: str = "parcel_id", **thresholds) -> DataFrame:
    kept = screen(df, **thresholds).join(explained_ids.select(key, F.lit(True).alias("_explained")), key, "left")
    return kept.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("CPI_technique").alias("mean_cpi"),
        F.count_if(F.col("consensus_confidence") >= 0.8).alias("n_high_conf"),
        F.count_if(F.col("gate_reason") != "").alias("n_gated"),
        F.count_if("_explained").alias("n_explained"),
    )


def shortlist(df: DataFrame, requests: DataFrame, request_col: str = "requested", key: str = "parcel_id", ref: str | None = None) -> DataFrame:
    """Requested ids in any spelling, matched to known ids; unknown and repeated ones fall out."""
    wanted = requests.select(compact_id(F.col(request_col)).alias("_id")).where(F.col("_id") != "").distinct()
    known = df.withColumn("_id", compact_id(F.col(ref or key).cast("string")))
    return known.join(wanted, "_id", "left_semi").drop("_id")


def _digits(c: Column, digits: int) -> Column:
    """Printed number; settled to six digits first, so noise in the last bits flips no printed digit."""
    return F.format_string(f"%.{digits}f", half_even(half_even(c, 6), digits))


def _percent(c: Column) -> Column:
    return F.concat(F.format_string("%.0f", half_even(half_even(c, 6) * 100.0, 0)), F.lit("%"))


def _listed(items: Sequence[Column], default: Sequence[str]) -> Column:
    found = F.slice(F.array_compact(F.array(*items)), 1, 3)
    return F.when(F.size(found) > 0, found).otherwise(F.array(*[F.lit(d) for d in default]))


def business_verdict(df: DataFrame, key: str = "parcel_id") -> DataFrame:
    """Verdict with at most three strengths, risks and actions, as ``ARRAY<STRING>``."""
    cpi, conf, slope = F.col("CPI_technique"), F.col("consensus_confidence"), F.col("slope_p90")
    wet, surface, spread = F.col("has_thalweg_mean"), F.col("surface_m2"), F.col("cpi_ml_std")
    slide, clay = F.col("brgm_mvt_terrain_flag"), F.col("brgm_argiles_flag")
    verdict = summary = None
    for bound, name, text in K.VERDICTS:
        if bound is None:
            verdict, summary = verdict.otherwise(name), summary.otherwise(text)
        else:
            verdict = F.when(cpi >= bound, name) if verdict is None else verdict.when(cpi >= bound, name)
            summary = F.when(cpi >= bound, text) if summary is None else summary.when(cpi >= bound, text)
    t = F.concat
    strengths = [
        F.when(slope < 10, t(F.lit("Pente max modérée ("), _digits(slope, 1), F.lit("°), favorable au coût d'aménagement."))),
        F.when(wet < 0.10, F.lit(K.STRENGTH_DRAINAGE)),
        F.when(surface >= 250, t(F.lit("Surface confortable ("), _digits(surface, 0), F.lit(" m²) pour flexibilité du programme."))),
        F.when(conf >= 0.8, t(F.lit("Confiance de consensus élevée ("), _percent(conf), F.lit("), signaux convergents."))),
        F.when(spread <= 3, t(F.lit("Score stable en bootstrap (±"), _digits(spread, 1), F.lit(" pts)."))),
    ]
    risks = [
        F.when(slope > 25, t(F.lit("Pente max élevée ("), _digits(slope, 1), F.lit("°), risque de surcoût terrassement."))),
        F.when(wet >= 0.30, F.lit(K.RISK_DRAINAGE)),
        F.when(surface < 120, t(F.lit("Surface réduite ("), _digits(surface, 0), F.lit(" m²), capacité de projet limitée."))),
        F.when(conf < 0.5, t(F.lit("Consensus faible ("), _percent(conf), F.lit("), signaux contradictoires."))),
        F.when(spread > 6, t(F.lit("Incertitude ML notable (écart-type "), _digits(spread, 1), F.lit(" pts)."))),
        F.when(slide, F.lit(K.RISK_LANDSLIDE)),
        F.when(clay, F.lit(K.RISK_CLAY)),
        F.when(F.col("gate_reason") != "", t(F.lit("Gate technique déclenchée : "), F.col("gate_reason"), F.lit("."))),
    ]
    actions = [
        F.when(slope > 25, F.lit(K.ACTION_EARTHWORKS)),
        F.when(wet >= 0.30, F.lit(K.ACTION_WATER)),
        F.when(conf < 0.5, F.lit(K.ACTION_SITE)),
        F.when(slide, F.lit(K.ACTION_GEOTECH)),
    ]
    return df.select(
        key,
        verdict.alias("verdict"),
        summary.alias("summary"),
        _listed(strengths, [K.STRENGTH_DEFAULT]).alias("strengths"),
        _listed(risks, [K.RISK_DEFAULT]).alias("risks"),
        _listed(actions, K.ACTIONS_DEFAULT).alias("actions"),
        F.coalesce(_percent(conf), F.lit("N/A")).alias("confidence_txt"),
    )


def shap_top_factors(df: DataFrame, features: Sequence[str] = tuple(K.FEATURES), top_pos: int = 3, top_neg: int = 2,
                     key: str = "parcel_id", prefix: str = "shap_") -> DataFrame:
    """Largest positive and most negative contributions of each parcel, sorted inside the row: no shuffle."""
    entry = lambda f: F.struct((F.col(prefix + f)).alias("v"), F.lit(f).alias("feature"))
    values = F.array(*[entry(f) for f in features])
    positive = F.filter(values, lambda e: e["v"] > 0)
    negative = F.filter(values, lambda e: e["v"] < 0)
    falling = F.array_sort(F.transform(positive, lambda e: F.struct((-e["v"]).alias("v"), e["feature"].alias("feature"))))
    rising = F.array_sort(negative)
    names = lambda a, n: F.transform(F.slice(a, 1, n), lambda e: e["feature"])
    return df.select(key, names(falling, top_pos).alias("top_positive"), names(rising, top_neg).alias("top_negative"))


def alerts(df: DataFrame, key: str = "parcel_id") -> DataFrame:
    items = F.array_compact(
        F.array(
            F.when(F.col("brgm_argiles_flag"), F.lit(K.ALERT_CLAY)),
            F.when(F.col("brgm_mvt_terrain_flag"), F.lit(K.ALERT_LANDSLIDE)),
            F.when(F.col("shape_warning") != "", F.concat(F.lit(K.ALERT_SHAPE), F.col("shape_warning"))),
            F.when(F.col("ces_warning") != "", F.concat(F.lit(K.ALERT_COVERAGE), F.col("ces_warning"))),
        )
    )
    return df.select(key, items.alias("alerts"))
