"""Projections, filters, imputation and keys."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwise import catalog as K
from lotwise.functions import geometry as G
from lotwise.functions.text import compact_id, padded_id, sale_id, zone_code
from lotwise.operators.order_stats import medians


def coerce_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.col(c).try_cast("double") for c in columns})


def sales_only(df: DataFrame) -> DataFrame:
    return df.where(F.coalesce(F.col("nature_mutation").contains(K.SALE_MARK), F.lit(False)))


def price_per_m2(df: DataFrame) -> DataFrame:
    """Positive value and surface, price within bounds; the surface rule falls when no surface is known."""
    paid = df.where(F.col("valeur_fonciere") > 0)
    if paid.where(F.col("surface_terrain").isNotNull()).isEmpty():
        return paid.withColumn("prix_m2", F.lit(None).cast("double"))
    priced = paid.where(F.col("surface_terrain") > 0).withColumn(
        "prix_m2", F.try_divide(F.col("valeur_fonciere"), F.col("surface_terrain"))
    )
    return priced.where(F.col("prix_m2").between(*K.PRICE_RANGE))


def commune_of(df: DataFrame) -> DataFrame:
    """First known commune column as ``_commune``; otherwise the first five characters of the id."""
    named = next((c for c in K.COMMUNE_COLUMNS if c in df.columns), None)
    source = F.col(named).cast("string") if named else F.substring(F.col("id_parcelle").cast("string"), 1, 5)
    return df.withColumn("_commune", F.trim(source))


def commune_filter(df: DataFrame, code: str = K.COMMUNE_CODE, min_rows: int = K.MIN_COMMUNE_SALES) -> DataFrame:
    """Rows of one commune when there are enough of them, else every row."""
    match = F.col("_commune") == code
    enough = df.where(match).limit(min_rows).count() >= min_rows
    return df.where(match) if enough else df


def prepare_sales(df: DataFrame, code: str = K.COMMUNE_CODE) -> DataFrame:
    clean = coerce_numeric(df, ["valeur_fonciere", "surface_terrain"])
    return commune_filter(commune_of(price_per_m2(sales_only(clean))), code)


def valid_geometry(df: DataFrame, ring: str = "ring") -> DataFrame:
    return df.where(G.is_valid_ring(F.col(ring)))


def null_ratio(columns: Sequence[str]) -> Column:
    if not columns:
        return F.lit(0.0)
    total = F.lit(0)
    for c in columns:
        total = total + F.col(c).isNull().cast("int")
    return total / F.lit(float(len(columns)))


def with_validity(df: DataFrame, features: Sequence[str] = tuple(K.FEATURES)) -> DataFrame:
    """``nan_ratio`` over the features that exist, and ``is_valid``."""
    ratio = null_ratio([c for c in features if c in df.columns])
    zone = F.coalesce(F.col("zone_plu").isin(*K.BUILDABLE_ZONES, K.UNKNOWN_ZONE), F.lit(False)) if "zone_plu" in df.columns else F.lit(True)
    ok = (
        (F.col("nan_ratio") <= K.MAX_NULL_RATIO)
        & F.coalesce(F.col("surface_m2").between(K.MIN_SURFACE_M2, K.MAX_SURFACE_M2), F.lit(False))
        & zone
    )
    return df.withColumn("nan_ratio", ratio).withColumn("is_valid", ok)


def filter_counters(df: DataFrame) -> DataFrame:
    zone_ok = F.coalesce(F.col("zone_plu").isin(*K.BUILDABLE_ZONES, K.UNKNOWN_ZONE), F.lit(False))
    return df.agg(
        F.count(F.lit(1)).alias("n_total"),
        F.count_if("is_valid").alias("n_valid"),
        F.count_if(F.col("nan_ratio") > K.MAX_NULL_RATIO).alias("n_too_null"),
        F.count_if(F.col("surface_m2") > K.MAX_SURFACE_M2).alias("n_too_big"),
        F.count_if(F.col("surface_m2") < K.MIN_SURFACE_M2).alias("n_too_small"),
        F.count_if(~zone_ok).alias("n_bad_zone"),
    )


def median_impute(
    df: DataFrame, columns: Sequence[str], default: float = 0.0, population: Column | None = None
) -> DataFrame:
    """Null takes the median of the column over ``population`` (all rows by default)."""
    base = df if population is None else df.where(population)
    fill = medians(base, columns)
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(default if fill[c] is None else fill[c])) for c in columns})


def default_fill(df: DataFrame, defaults: Mapping[str, float] = K.LABEL_DEFAULTS) -> DataFrame:
    present = lambda c: F.col(c) if c in df.columns else F.lit(None).cast("double")
    return df.withColumns({c: F.coalesce(present(c), F.lit(v)) for c, v in defaults.items()})


def normalize_parcel_id(df: DataFrame, column: str) -> DataFrame:
    c = F.col(column)
    return df.withColumns({"id_padded": padded_id(c), "id_compact": compact_id(c), "id_sale": sale_id(c)})


def normalize_zone(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn("zone_norm", zone_code(F.col(column)))


def bbox_filter(df: DataFrame, box=K.STUDY_BBOX) -> DataFrame:
    x0, y0, x1, y1 = box
    return df.where((F.col("xmax") >= x0) & (F.col("xmin") <= x1) & (F.col("ymax") >= y0) & (F.col("ymin") <= y1))


def feature_availability(df: DataFrame, families: Mapping[str, Sequence[str]] = K.FAMILY_COLUMNS) -> DataFrame:
    """One row per family: all columns exist and at least one value is known. One pass over the table."""
    known = sorted({c for cols in families.values() for c in cols if c in df.columns})
    counts = df.agg(*[F.count(c).alias(c) for c in known])
    items = []
    for name, cols in families.items():
        if all(c in known for c in cols):
            seen = F.lit(0)
            for c in cols:
                seen = seen + F.col(c)
            ok = seen > 0
        else:
            ok = F.lit(False)
        items.append(F.struct(F.lit(name).alias("family"), ok.alias("available")))
    return counts.select(F.inline(F.array(*items)))


def drop_all_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.dropna(how="all", subset=list(columns))


def export_projection(df: DataFrame, key: str = "parcel_id") -> DataFrame:
    """Export columns in order, only existing ones; the id is always kept."""
    hazards = sorted(c for c in df.columns if c.startswith("brgm_"))
    order = [*K.EXPORT_META, *K.FEATURES, *K.EXPORT_SCORES, *hazards, *K.EXPORT_VALUE]
    return df.select(key, *[c for c in order if c in df.columns])


def ml_dataset(df: DataFrame, key: str = "parcel_id") -> DataFrame:
    cols = [key, "block_id", *[f for f in K.FEATURES if f in df.columns], "proxy_label", "CPI_v3"]
    return df.where(F.col("is_valid") & (F.col("proxy_label") != -1)).select(*[c for c in cols if c in df.columns])


def parcel_id_coalesce(df: DataFrame, named: str, geometry_id: str, position: str, out: str = "parcel_key") -> DataFrame:
    return df.withColumn(out, F.coalesce(F.col(named), F.col(geometry_id), F.col(position).cast("string")))
