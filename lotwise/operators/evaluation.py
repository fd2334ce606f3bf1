"""Spatial folds and ranking metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lotwise.operators.order_stats import average_rank, value_positions
from lotwise.session import materialise

RANGES = 64  # parts in which blocks are ranked
SHARE = 100_000  # ranks of one row of the driver's table at most


def equal_shares(loads: list[int], n: int, m: int) -> list[int]:
    """How many of ``m`` blocks of ``n`` rows each fold gets when each goes to the lightest fold, the first of equals."""
    below = lambda t: [max(0, -(-(t - load) // n)) for load in loads]  # blocks placed while a fold's load is under t
    lo, hi = min(loads), max(loads) + n * m + 1
    while lo < hi:  # the greatest t with at most m such blocks
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if sum(below(mid)) <= m else (lo, mid - 1)
    out = below(lo)
    for f, load in enumerate(loads):  # the rest go to the folds whose load is t exactly
        if sum(out) < m and load + out[f] * n == lo:
            out[f] += 1
    return out


def group_kfold(df: DataFrame, n_folds: int = 5, block: str = "block_id") -> DataFrame:
    """Column ``fold``: a block is never split, largest block to the lightest fold, equal ones by id.

    Blocks of one size differ by their rank only, so the driver packs the histogram of sizes (at most the square root of twice
    the rows has distinct entries) and Spark turns ranks into folds: the j-th block of a fold comes when the fold's load is
    its load before plus j sizes, and its rank is the number of blocks that come earlier.
    """
    counts = df.where(F.col(block).isNotNull()).groupBy(block).agg(F.count(F.lit(1)).alias("n"))
    parted = materialise(counts.repartitionByRange(RANGES, block).withColumn("part", F.spark_partition_id()), "blocks")
    sizes = parted.groupBy("n").agg(F.count(F.lit(1)).alias("m")).orderBy(F.col("n").desc()).collect()
    n_blocks = sum(r.m for r in sizes)
    k = min(n_folds, n_blocks)
    if k < 2:
        raise ValueError("spatial folds need at least two blocks")
    loads, packed = [0] * k, []
    for r in sizes:
        shares = equal_shares(loads, r.n, r.m)
        packed += [(r.n, f, list(loads), i * SHARE, min(shares[f] - i * SHARE, SHARE)) for f in range(k) for i in range(-(-shares[f] // SHARE))]
        loads = [load + share * r.n for load, share in zip(loads, shares, strict=True)]
    turns = df.sparkSession.createDataFrame(packed, "n long, fold int, loads array<long>, first long, share long")
    turns = turns.select("n", "fold", "loads", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("share") - 1)).alias("j"))
    at = F.get("loads", F.col("fold")) + F.col("j") * F.col("n")
    earlier = F.transform("loads", lambda load, g: F.when(at < load, F.lit(0).cast("long")).otherwise(
        F.floor((at - load) / F.col("n")).cast("long") + ((F.pmod(at - load, F.col("n")) > 0) | (g < F.col("fold"))).cast("long")))
    turns = turns.select("n", "fold", F.aggregate(earlier, F.lit(0).cast("long"), lambda a, x: a + x).alias("rank"))
    before = parted.groupBy("n", "part").count()
    before = before.withColumn("before", F.coalesce(F.sum("count").over(W.partitionBy("n").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    ranked = parted.withColumn("own", F.row_number().over(W.partitionBy("n", "part").orderBy(block))).join(before, ["n", "part"])
    folds = ranked.select(block, "n", (F.col("own") - 1 + F.col("before")).alias("rank")).join(turns, ["n", "rank"])
    return df.drop("fold").join(folds.select(block, "fold"), block, "left")


def _top(df: DataFrame, group: Sequence[str], order: str, k: int, key: str) -> DataFrame:
    """First k rows per group. Spark limits the groups before the shuffle, so a large group sends k rows
    per task."""
    w = W.partitionBy(*group).orderBy(F.col(order).desc(), F.col(key))
    return df.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k)


def ndcg_at_k(df: DataFrame, k: int = 20, group: Sequence[str] = ("fold",), label: str = "label", score: str = "score", key: str = "parcel_id") -> DataFrame:
    gain = lambda d, n: d.groupBy(*group).agg(F.sum(F.col(label).cast("double") / F.log2(F.col("rn") + 1.0)).alias(n))
    dcg = gain(_top(df, group, score, k, key), "dcg")
    ideal = gain(_top(df, group, label, k, key), "idcg")
    ratio = F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")).otherwise(0.0)
    return dcg.join(ideal, list(group)).select(*group, ratio.alias("ndcg"))


def precision_at_k(df: DataFrame, k: int = 20, group: Sequence[str] = ("fold",), label: str = "label", score: str = "score", key: str = "parcel_id") -> DataFrame:
    return _top(df, group, score, k, key).groupBy(*group).agg(F.avg(F.col(label).cast("double")).alias("precision"))


def auc(df: DataFrame, group: Sequence[str] = ("fold",), label: str = "label", score: str = "score") -> DataFrame:
    """Area under the ROC curve from average ranks; groups with one class are left out."""
    places = value_positions(df, list(group), score, {"n_pos": F.sum(F.col(label).cast("long"))})
    sums = places.groupBy(*group).agg(
        F.sum(F.col("n_pos") * average_rank()).alias("_ranks"), F.sum("n_pos").alias("_p"), F.sum("n").alias("_n")
    )
    p, n = F.col("_p"), F.col("_n")
    value = (F.col("_ranks") - p * (p + 1) / 2.0) / (p.cast("double") * (n - p))
    return sums.where((p > 0) & (p < n)).select(*group, value.alias("auc"))


def spearman(df: DataFrame, a: str, b: str, group: Sequence[str] = (), out: str = "spearman") -> DataFrame:
    """Pearson correlation of average ranks over rows where both values are known.

    Equal pairs are counted first, so repeated values shrink before any join.
    """
    group = list(group)
    pairs = (
        df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
        .groupBy(*group, F.col(a).cast("double").alias(a), F.col(b).cast("double").alias(b))
        .agg(F.count(F.lit(1)).alias("w"))
    )
    known = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    centred = average_rank() - (F.col("total") + 1) / 2.0
    ra = value_positions(known, group, a).select(*group, a, centred.alias("_ra"))
    rb = value_positions(known, group, b).select(*group, b, centred.alias("_rb"))
    both = pairs.join(ra, [*group, a]).join(rb, [*group, b])
    s = lambda x, y: F.sum(F.col("w") * F.col(x) * F.col(y))
    rho = F.try_divide(s("_ra", "_rb"), F.sqrt(s("_ra", "_ra") * s("_rb", "_rb"))).alias(out)
    return both.groupBy(*group).agg(rho) if group else both.agg(rho)


def score_gap(df: DataFrame, a: str = "CPI_v3", b: str = "CPI_ML_v3", min_rows: int = 10) -> DataFrame:
    """Mean and largest gap and Pearson correlation, when enough rows have both scores."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    gap = F.when(both, F.abs(F.col(b) - F.col(a)))
    got = df.agg(F.count_if(both).alias("n_common"), F.avg(gap).alias("mean_gap"), F.max(gap).alias("max_gap"), F.corr(a, b).alias("pearson"))
    return got.where(F.col("n_common") > min_rows)


def confusion_matrix(df: DataFrame, label: str = "label", predicted: str = "predicted", group: str = "fold") -> DataFrame:
    """Counts per fold, averaged over folds and truncated; precision and recall of the averages."""
    y, p = F.col(label), F.col(predicted)
    per = df.groupBy(group).agg(
        F.count_if((y == 0) & (p == 0)).alias("tn"), F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"), F.count_if((y == 1) & (p == 1)).alias("tp"),
    )
    mean = per.agg(*[F.avg(c).cast("long").alias(c) for c in ("tn", "fp", "fn", "tp")])
    return mean.withColumns(
        {
            "precision": F.col("tp") / (F.col("tp") + F.col("fp") + 1e-9),
            "recall": F.col("tp") / (F.col("tp") + F.col("fn") + 1e-9),
        }
    )


def fold_metrics(df: DataFrame, k: int = 20, reference: str | None = None, group: Sequence[str] = ("model", "fold")) -> DataFrame:
    """AUC, precision and NDCG at k, and Spearman against a reference score, per model and fold."""
    group = list(group)
    out = ndcg_at_k(df, k, group).join(precision_at_k(df, k, group), group, "left").join(auc(df, group), group, "left")
    if reference:
        out = out.join(spearman(df, "score", reference, group), group, "left")
    return out


def model_comparison(metrics: DataFrame, columns: Sequence[str] = ("auc", "precision", "ndcg")) -> DataFrame:
    """Mean and population std per model over folds; the best model by mean NDCG is marked."""
    per = metrics.groupBy("model").agg(
        *[f(c).alias(f"{c}_{n}") for c in columns for n, f in (("mean", F.avg), ("std", F.stddev_pop))]
    )
    best = per.agg(F.max_by("model", F.struct(F.col("ndcg_mean"), F.col("model"))).alias("_best"))
    return per.join(F.broadcast(best), F.col("model") == F.col("_best"), "left").withColumn("is_best", F.col("_best").isNotNull()).drop("_best")
