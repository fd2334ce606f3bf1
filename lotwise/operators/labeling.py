"""Weak supervision: rule votes from terrain, market and clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwise import catalog as K
from lotwise.functions.text import sale_id
from lotwise.operators.cleaning import default_fill
from lotwise.operators.order_stats import global_quantiles, grouped_quantiles


def _flag(cond: Column) -> Column:
    return F.coalesce(cond, F.lit(False)).cast("int")


def terrain_votes(df: DataFrame) -> DataFrame:
    """H1 (easy ground) and H2 (difficult ground), on values with defaults filled in."""
    names = list(K.LABEL_DEFAULTS)
    filled = default_fill(df.withColumns({f"_{c}": F.col(c) if c in df.columns else F.lit(None).cast("double") for c in names}),
                          {f"_{c}": v for c, v in K.LABEL_DEFAULTS.items()})
    p90, std, wet, surface = (F.col(f"_{c}") for c in ("slope_p90", "slope_std", "has_thalweg_mean", "surface_m2"))
    return filled.withColumns(
        {
            "h1": _flag((p90 < 10.0) & (std < 5.0) & (wet < 0.10) & (surface > 150.0)),
            "h2": _flag((p90 > 25.0) | (wet > 0.30) | (std > 15.0)),
        }
    ).drop(*[f"_{c}" for c in names])


def price_quantiles(sales: DataFrame) -> dict[str, float | None]:
    p20, p50, p80 = global_quantiles(sales, {"p": ("prix_m2", [0.2, 0.5, 0.8])})["p"]
    return {"p20": p20, "median": p50, "p80": p80}


def median_price_per_id(sales: DataFrame) -> DataFrame:
    keyed = sales.select(sale_id(F.col("id_parcelle").cast("string")).alias("sale_id"), "prix_m2")
    return grouped_quantiles(keyed, ["sale_id"], [(F.col("prix_m2"), {"median_price": 0.5})])


def price_lookup(parcels: DataFrame, sales: DataFrame, key: str = "parcel_id") -> DataFrame:
    """Median price per id, looked up per parcel."""
    ids = parcels.select(key, sale_id(F.col(key).cast("string")).alias("sale_id"))
    return ids.join(median_price_per_id(sales), "sale_id", "left").select(key, "median_price")


def market_votes(df: DataFrame, sales: DataFrame | None, key: str = "parcel_id") -> DataFrame:
    """H3 above the 80th and H4 below the 20th percentile of transaction prices."""
    if sales is None:
        return df.withColumns({"h3": F.lit(0), "h4": F.lit(0)})
    q = price_quantiles(sales)
    priced = df.join(price_lookup(df.select(key), sales, key), key, "left")
    above = F.col("median_price") > F.lit(q["p80"])
    below = F.col("median_price") < F.lit(q["p20"])
    return priced.withColumns({"h3": _flag(above), "h4": _flag(below)}).drop("median_price")


def cluster_votes(df: DataFrame, column: str = "cluster_score") -> DataFrame:
    """H5 from the cluster scores of an earlier run."""
    return df.withColumns({"h5_pos": _flag(F.col(column) > 80), "h5_neg": _flag(F.col(column) < 20)})


def clusters_available(df: DataFrame, column: str = "cluster_score") -> bool:
    return not df.where(F.col(column).isNotNull()).isEmpty()


def vote(df: DataFrame, with_clusters: bool) -> DataFrame:
    """``proxy_label``: 1, 0, or -1 when no side reaches the threshold; a draw is positive."""
    h = lambda c: F.col(c).cast("double")
    if with_clusters:
        pos = h("h1") * 0.40 + h("h3") * 0.45 + h("h5_pos") * 0.15
        neg = h("h2") * 0.75 + h("h4") * 0.20 + h("h5_neg") * 0.05
    else:
        pos = h("h1") * 0.50 + h("h3") * 0.50
        neg = h("h2") * 0.75 + h("h4") * 0.25
    label = (
        F.when((pos >= neg) & (pos >= K.VOTE_THRESHOLD), 1)
        .when((neg > pos) & (neg >= K.VOTE_THRESHOLD), 0)
        .otherwise(-1)
    )
    return df.withColumn("proxy_label", label)


def weak_labels(df: DataFrame, sales: DataFrame | None = None, prior_cluster: str | None = "cluster_score", key: str = "parcel_id") -> DataFrame:
    votes = market_votes(terrain_votes(df), sales, key)
    if prior_cluster is None or prior_cluster not in df.columns:
        return vote(votes.withColumns({"h5_pos": F.lit(0), "h5_neg": F.lit(0)}), False)
    return vote(cluster_votes(votes, prior_cluster), clusters_available(df, prior_cluster))


def block_balance(df: DataFrame) -> DataFrame:
    """Positives, count and ratio per block over labelled rows (valid or not)."""
    labelled = df.where(F.col("proxy_label") != -1)
    return labelled.groupBy("block_id").agg(
        F.sum("proxy_label").alias("n_pos"),
        F.count(F.lit(1)).alias("n"),
        (F.sum("proxy_label") / F.count(F.lit(1))).alias("ratio"),
    )


def block_classes(balance: DataFrame) -> DataFrame:
    r = F.col("ratio")
    counts = balance.agg(
        F.count_if((r >= 0.10) & (r <= 0.90)).alias("mixed"),
        F.count_if(r > 0.90).alias("pure_pos"),
        F.count_if(r < 0.10).alias("pure_neg"),
        F.count(F.lit(1)).alias("total"),
    )
    return counts.withColumn("many_pure", F.col("pure_pos") + F.col("pure_neg") > F.col("total") * 0.3)
