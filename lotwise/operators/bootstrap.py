"""Bootstrap of the learned score by Poisson weights: no resampled copies, same draws on any layout."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwise.operators import boosting
from lotwise.session import materialise

RATE = 0.8


def _uniform(key: Column, run: Column | int) -> Column:
    """Uniform number in [0, 1) from the md5 of key and run."""
    run = F.lit(run) if isinstance(run, int) else run
    digest = F.md5(F.concat_ws(":", key.cast("string"), run.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / 4294967296.0


def poisson_weight(key: Column, run: Column | int, rate: float = RATE) -> Column:
    """How often a row is drawn: Poisson by inversion, the limit of drawing ``rate * n`` with replacement."""
    u = _uniform(key, run)
    weight, term, total = F.lit(0), math.exp(-rate), math.exp(-rate)
    for i in range(1, 12):
        weight = weight + (u >= total).cast("int")
        term *= rate / i
        total += term
    return weight


def bootstrap_weights(df: DataFrame, runs: int = 100, key: str = "parcel_id") -> DataFrame:
    """Drawn rows per run: (run, key, weight), rows drawn zero times left out."""
    exploded = df.select(key, F.explode(F.sequence(F.lit(0), F.lit(runs - 1))).alias("run"))
    return exploded.withColumn("weight", poisson_weight(F.col(key), F.col("run"))).where(F.col("weight") > 0)


def bootstrap_scores(
    labelled: DataFrame, valid: DataFrame, features: Sequence[str], runs: int = 100, label: str = "proxy_label", key: str = "parcel_id",
    n_estimators: int = 100, max_depth: int = 3, learning_rate: float = 0.05, seed: int = 42, maxIter: int | None = None,
) -> DataFrame:
    """Scores (run, key, p) of a boosted classifier per draw, min-maxed per run. All draws grow side by side, each with its own
    weights of the rows, and score ``valid`` in one scan. ``maxIter`` is another name for ``n_estimators``."""
    n_estimators = n_estimators if maxIter is None else maxIter
    specs = [boosting.Spec(max_depth, learning_rate, seed + run) for run in range(runs)]
    weights = [poisson_weight(F.col(key), run) for run in range(runs)]
    model = boosting.train(labelled, features, specs, n_estimators, "logistic", key, label, weights=weights, least_child=1.0)
    odds = model.score(valid, [key]).select(F.col("model").alias("run"), key, (1.0 / (1.0 + F.exp(-F.col("score")))).alias("_p"))
    long = materialise(odds, "bootstrap-scores")
    ends = long.groupBy("run").agg(F.min("_p").alias("_a"), F.max("_p").alias("_b"))  # one row per run
    return long.join(F.broadcast(ends), "run").select(
        "run", key, ((F.col("_p") - F.col("_a")) / (F.col("_b") - F.col("_a") + 1e-9) * 100.0).alias("p")
    )


def bootstrap_ci(long: DataFrame, confidence: float = 0.95, key: str = "parcel_id") -> DataFrame:
    """Mean, population std and interval per parcel; a group holds one row per run."""
    ends = F.percentile("p", F.array(F.lit((1 - confidence) / 2), F.lit((1 + confidence) / 2)))
    got = long.groupBy(key).agg(F.avg("p").alias("cpi_ml_mean"), F.stddev_pop("p").alias("cpi_ml_std"), ends.alias("_q"))
    return got.select(
        key, "cpi_ml_mean", "cpi_ml_std", F.get("_q", F.lit(0)).alias("cpi_ml_ci_low"), F.get("_q", F.lit(1)).alias("cpi_ml_ci_high")
    )


def ci_stability(intervals: DataFrame) -> DataFrame:
    width = F.col("cpi_ml_ci_high") - F.col("cpi_ml_ci_low")
    return intervals.agg(
        F.count_if(width < 5).alias("n_stable"), F.count_if(width > 15).alias("n_unstable"), (F.avg(width) / 2.0).alias("mean_half_width")
    )
