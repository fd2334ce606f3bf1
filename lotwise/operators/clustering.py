"""Clusters as a check of the weak labels, and the cluster score."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwise import catalog as K
from lotwise.functions.numeric import add_all, clip
from lotwise.operators.cleaning import median_impute
from lotwise.operators.order_stats import grouped_quantiles
from lotwise.session import materialise, side_by_side

NOISE = 1e-12  # relative; means of equal values differ by less, as their sums depend on the order of the rows
PROFILE_COLUMNS = [*K.CLUSTER_LOWER_IS_BETTER, *K.CLUSTER_HIGHER_IS_BETTER]


def usable_columns(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Columns that exist and hold a value."""
    present = [c for c in columns if c in df.columns]
    counts = df.agg(*[F.count(c).alias(c) for c in present]).first()
    return [c for c in present if counts[c]]


def fit_standard(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population std; a constant column keeps the divisor 1."""
    row = df.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    return {c: (row[f"m_{c}"] or 0.0, row[f"s_{c}"] or 1.0) for c in columns}


def standard_scale(df: DataFrame, columns: Sequence[str], fitted: dict | None = None, prefix: str = "z_") -> DataFrame:
    fitted = fitted or fit_standard(df, columns)
    return df.withColumns({prefix + c: (F.col(c) - fitted[c][0]) / fitted[c][1] for c in columns})


def kmeans4(df: DataFrame, columns: Sequence[str], k: int = 4, seed: int = 42, restarts: int = 10, key: str = "parcel_id"):
    """K-means on imputed, scaled columns; the best of several starts. Returns (rows, centres)."""
    cols = usable_columns(df, columns)
    scaled = standard_scale(median_impute(df, cols, 0.0), cols)
    points = VectorAssembler(inputCols=["z_" + c for c in cols], outputCol="vec").transform(scaled).select(key, "vec")
    points = materialise(points, "kmeans-points").persist()  # one copy for all starts, rebuilt from the table if lost
    start = lambda i: KMeans(k=k, seed=seed + i, maxIter=50, featuresCol="vec", predictionCol="cluster_id").fit(points)
    fitted = side_by_side(df.sparkSession, [lambda i=i: start(i) for i in range(restarts)])
    best = min(fitted, key=lambda m: m.summary.trainingCost)
    points.unpersist()
    return best.transform(points).select(key, "cluster_id"), [list(map(float, c)) for c in best.clusterCenters()], cols


def cluster_profile(df: DataFrame, cluster: str = "cluster_id", label: str = "proxy_label") -> DataFrame:
    """Medians of the profile columns per cluster and the mean label without abstentions."""
    rate = F.avg(F.nullif(F.col(label), F.lit(-1))).alias("label_rate")
    wanted = [(F.col(c), {c: 0.5}) for c in PROFILE_COLUMNS if c in df.columns]
    return grouped_quantiles(df, [cluster], wanted, [rate])


def constructibility(profile: DataFrame) -> DataFrame:
    """Mean of min-max scaled medians, inverted where lower is better; a flat column counts one half.

    A column whose medians differ by rounding only is flat; scaling would blow that up to 0 and 1.
    ``profile`` has one row per cluster. Without any usable column the label rate decides, else one half.
    """
    ends = profile.agg(*[f(c).alias(n + c) for c in profile.columns for n, f in (("a_", F.min), ("b_", F.max))]).first()
    parts: list[Column] = []
    for columns, lower in ((K.CLUSTER_LOWER_IS_BETTER, True), (K.CLUSTER_HIGHER_IS_BETTER, False)):
        for c in columns:
            if c not in profile.columns or ends["a_" + c] is None:
                continue
            a, b = ends["a_" + c], ends["b_" + c]
            n = F.coalesce((F.col(c) - a) / (b - a), F.lit(0.5)) if b - a > NOISE * max(abs(a), abs(b)) else F.lit(0.5)
            parts.append(F.lit(1.0) - n if lower else n)
    if parts:
        score = add_all(parts) / float(len(parts))
    elif "label_rate" in profile.columns and ends["a_label_rate"] is not None:
        mid = profile.agg(F.percentile("label_rate", F.lit(0.5))).first()[0]
        score = F.coalesce("label_rate", F.lit(mid))
    else:
        score = F.lit(0.5)
    return profile.withColumn("constructibility_score", score)


def best_and_worst(ranked: DataFrame, cluster: str = "cluster_id") -> tuple[int, int]:
    """Ends of the order by score (desc) and cluster (asc); one row per cluster reaches the driver."""
    rows = ranked.orderBy(F.col("constructibility_score").desc(), F.col(cluster)).select(cluster).collect()
    return rows[0][0], rows[-1][0]


def cluster_agreement(df: DataFrame, best: int, worst: int, cluster: str = "cluster_id", label: str = "proxy_label") -> DataFrame:
    """Share of positives in the best cluster, of negatives in the worst, and of both pooled, in percent."""
    pos, neg = F.col(label) == 1, F.col(label) == 0
    in_best, in_worst = F.col(cluster) == best, F.col(cluster) == worst
    share = lambda hit, of: F.avg(F.when(of, hit.cast("double"))) * 100.0
    pooled = F.when(pos, in_best.cast("double")).when(neg, in_worst.cast("double"))
    return df.agg(
        share(in_best, pos).alias("pure_pos_in_best"),
        share(in_worst, neg).alias("pure_neg_in_worst"),
        (F.avg(pooled) * 100.0).alias("cluster_label_agreement"),
    )


def cluster_score(df: DataFrame, columns: Sequence[str], best: Sequence[float], worst: Sequence[float], key: str = "parcel_id") -> DataFrame:
    """Closeness to the best centre against the worst, 0..100; ``columns`` are already scaled."""
    def gap(centre):
        return F.sqrt(add_all([(F.col(c) - float(m)) * (F.col(c) - float(m)) for c, m in zip(columns, centre)]))

    near, far = gap(best), gap(worst)
    score = (F.lit(1.0) - near / (near + far + 1e-9)) * 100.0
    return df.select(key, clip(score, 0.0, 100.0).alias("cluster_score"))


def validate_labels(df: DataFrame, columns: Sequence[str] = tuple(K.FEATURES), key: str = "parcel_id", **kw):
    """The whole check: clusters, profile, agreement row and cluster score of every row."""
    assigned, centres, cols = kmeans4(df, columns, key=key, **kw)
    joined = df.join(assigned, key)
    ranked = constructibility(cluster_profile(joined))
    best, worst = best_and_worst(ranked)
    filled = standard_scale(median_impute(df, cols, 0.0), cols)
    score = cluster_score(filled, ["z_" + c for c in cols], centres[best], centres[worst], key)
    return cluster_agreement(joined, best, worst), score
