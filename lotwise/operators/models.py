"""Models: classifiers of Spark ML, a boosted ranker, cross-validation, contributions of features.

The ranker boosts trees on pairwise NDCG gradients (``boosting``). It pairs rows only with the first ``k`` of
their block, so the pairs grow linearly with the rows and not with the square of a block.
"""

from __future__ import annotations

import random
from collections.abc import Callable, Iterable, Mapping, Sequence
from functools import reduce
from itertools import product

from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lotwise import catalog as K
from lotwise.functions.numeric import add_all, half_even
from lotwise.operators import boosting
from lotwise.operators.evaluation import ndcg_at_k
from lotwise.session import materialise, side_by_side

# fixed values: combinations tried for the ranker
RANKER_GRID = {"n_estimators": [100, 200, 300], "max_depth": [3, 4, 5], "learning_rate": [0.03, 0.05, 0.1]}

Scorer = Callable[[DataFrame], DataFrame]


def assemble(columns: Sequence[str], out: str = "features") -> VectorAssembler:
    return VectorAssembler(inputCols=list(columns), outputCol=out)


def _probability(model: Transformer) -> Scorer:
    def score(df: DataFrame) -> DataFrame:
        done = model.transform(df)
        keep = [*df.columns, vector_to_array("probability")[1].alias("score"), F.col("prediction").cast("int").alias("predicted")]
        return done.select(*keep)

    return score


def fit_logistic(df: DataFrame, features: Sequence[str], label: str = "label", **params) -> Scorer:
    raw = assemble(features, "_raw")
    scaler = StandardScaler(inputCol="_raw", outputCol="features", withMean=True).fit(raw.transform(df))
    model = LogisticRegression(labelCol=label, maxIter=params.pop("maxIter", 2000), **params).fit(scaler.transform(raw.transform(df)))
    return _probability(PipelineModel([raw, scaler, model]))


def fit_forest(df: DataFrame, features: Sequence[str], label: str = "label", **params) -> Scorer:
    params = {"numTrees": 300, "maxDepth": 6, "seed": 42, **params}
    vec = assemble(features)
    return _probability(PipelineModel([vec, RandomForestClassifier(labelCol=label, **params).fit(vec.transform(df))]))


def fit_boosted(df: DataFrame, features: Sequence[str], label: str = "label", **params) -> Scorer:
    params = {"maxIter": 100, "maxDepth": 3, "stepSize": 0.05, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8", "seed": 42, **params}
    vec = assemble(features)
    return _probability(PipelineModel([vec, GBTClassifier(labelCol=label, **params).fit(vec.transform(df))]))


# --- ranker ------------------------------------------------------------------------------------------------
def ranking_gradients(df: DataFrame, query: str, k: int = 20, key: str = "parcel_id", label: str = "label") -> DataFrame:
    """Gradient and curvature of the NDCG@k pair loss for every row (``score`` is the current score).

    Pairs join a row with the first k of its query when their labels differ. A swap is worth the change
    in discount; places behind k have none.
    """
    y, s = F.col(label).cast("double"), F.col("score")
    order = W.partitionBy(query).orderBy(F.col("score").desc(), F.col(key))
    head = df.select(query, key, label, "score", F.row_number().over(order).alias("rn")).where(F.col("rn") <= k)
    entry = F.struct(F.col("rn"), F.col(key).alias("id"), y.alias("y"), s.alias("s"))
    heads = head.groupBy(query).agg(F.collect_list(entry).alias("_head"))  # k entries per query
    totals = df.groupBy(query).agg(F.sum(y).alias("_p"))
    steps = F.transform(F.sequence(F.lit(1), F.lit(k)), lambda i: F.struct(i.alias("i"), (F.lit(1.0) / F.log2(i + 1.0)).alias("g")))
    ideal = F.aggregate(steps, F.lit(0.0), lambda acc, e: acc + F.when(e["i"] <= F.col("_p"), e["g"]).otherwise(0.0))
    heads = heads.join(totals, query).withColumn("_ideal", ideal)

    joined = df.join(heads, query)
    place = F.filter("_head", lambda e: e["id"] == F.col(key))
    own = F.when(F.size(place) > 0, F.get(place, F.lit(0))["rn"])
    discount = lambda rn: F.coalesce(F.lit(1.0) / F.log2(rn + 1.0), F.lit(0.0))
    joined = joined.withColumn("_own", own)

    def pair(e):
        """Gradient for this row of the pair with head entry ``e``; zero for equal labels."""
        sign = y - e["y"]
        weight = F.try_divide(F.abs(discount(e["rn"]) - discount(F.col("_own"))), F.col("_ideal"))
        rho = F.lit(1.0) / (F.lit(1.0) + F.exp(sign * (s - e["s"])))
        return F.struct(e["rn"].alias("rn"), (sign * rho * weight).alias("g"), (F.abs(sign) * rho * (F.lit(1.0) - rho) * weight).alias("h"))

    joined = joined.withColumn("_pairs", F.when(F.col("_ideal") > 0, F.transform("_head", pair)))
    total = lambda f: F.coalesce(F.aggregate("_pairs", F.lit(0.0), lambda acc, e: acc + F.coalesce(e[f], F.lit(0.0))), F.lit(0.0))
    rows = joined.withColumns({"_g": total("g"), "_h": total("h")})
    # the reaction on head rows of pairs with rows behind the head; summed before the shuffle
    back = (
        rows.where(F.col("_own").isNull()).select(query, F.explode("_pairs").alias("e"))
        .groupBy(query, F.col("e.rn").alias("_own")).agg((-F.sum("e.g")).alias("_bg"), F.sum("e.h").alias("_bh"))
    )
    rows = rows.join(back, [query, "_own"], "left")
    grad = F.col("_g") + F.coalesce("_bg", F.lit(0.0))
    hess = F.col("_h") + F.coalesce("_bh", F.lit(0.0))
    return rows.select(*df.columns, grad.alias("grad"), hess.alias("hess"))


class Ranker:
    """A fitted ranker; ``transform`` adds ``score``."""

    def __init__(self, model: boosting.Boosted):
        self.model = model

    def transform(self, df: DataFrame) -> DataFrame:
        return self.model.score(df, df.columns).drop("model")


def fit_ranker(
    df: DataFrame, features: Sequence[str], query: str = "block_id", label: str = "label", key: str = "parcel_id",
    n_estimators: int = 300, max_depth: int = 4, learning_rate: float = 0.05, k: int = 20, seed: int = 42,
) -> Ranker:
    """Trees boosted on the NDCG@k pair loss; rows are compared within their ``query``."""
    spec = boosting.Spec(max_depth, learning_rate, seed)
    return Ranker(boosting.train(df, features, [spec], n_estimators, "ndcg", key, label, query, k=k))


def rankers_out_of_fold(
    df: DataFrame, features: Sequence[str], specs: Sequence[boosting.Spec], looks: Sequence[int],
    query: str = "block_id", label: str = "label", key: str = "parcel_id", k: int = 20,
) -> DataFrame:
    """(key, ``label``, ``fold``, ``model``, ``n_estimators``, ``score``): held-out rows of every ranker after each number of trees."""
    model = boosting.train(df, features, specs, max(looks), "ndcg", key, label, query, "fold", k=k)
    return materialise(model.out_of_fold(df, [key, label, "fold"], looks), "out-of-fold")


def cross_validate_ranker(df: DataFrame, features: Sequence[str], folds: Iterable[int], n_estimators: int = 300, max_depth: int = 4, learning_rate: float = 0.05, seed: int = 42) -> DataFrame:
    """Out-of-fold scores of the ranker; the models of all folds are grown side by side."""
    specs = [boosting.Spec(max_depth, learning_rate, seed, f) for f in folds]
    return rankers_out_of_fold(df, features, specs, [n_estimators]).drop("model", "n_estimators").withColumn("model", F.lit("ranker"))


# --- cross-validation ----------------------------------------------------------------------------------------
def cross_validate(df: DataFrame, fit: Callable[[DataFrame], Scorer], name: str, folds: Iterable[int]) -> DataFrame:
    """Out-of-fold scores of one model: a fit per fold, each on the rows of the other folds."""
    folds = list(folds)
    scorers = side_by_side(df.sparkSession, [lambda f=f: fit(df.where(F.col("fold") != f)) for f in folds])
    parts = [score(df.where(F.col("fold") == f)) for f, score in zip(folds, scorers)]
    return reduce(DataFrame.unionByName, parts).withColumn("model", F.lit(name))


def grid_search(df: DataFrame, features: Sequence[str], grid: Mapping[str, Sequence] = RANKER_GRID, folds: Iterable[int] = range(5), k: int = 20, seed: int = 42) -> DataFrame:
    """Mean NDCG at k over folds per combination of the ranker, with the first strictly best one marked.

    Every depth and rate is grown on every fold side by side, up to the largest number of trees; a smaller number is a look on the way.
    """
    combos = list(product(*(grid[n] for n in ("n_estimators", "max_depth", "learning_rate"))))
    pairs = sorted({(depth, rate) for _, depth, rate in combos})
    specs = [boosting.Spec(depth, rate, seed, f) for depth, rate in pairs for f in folds]
    scores = rankers_out_of_fold(df, features, specs, sorted({n for n, _, _ in combos}), k=k)
    spark = df.sparkSession
    named = spark.createDataFrame([(i, s.depth, s.rate) for i, s in enumerate(specs)], "model int, max_depth int, learning_rate double")
    group = ["n_estimators", "max_depth", "learning_rate"]
    per_fold = ndcg_at_k(scores.join(F.broadcast(named), "model"), k, [*group, "fold"])
    mean = {(r.n_estimators, r.max_depth, r.learning_rate): r.ndcg for r in per_fold.groupBy(*group).agg(F.avg("ndcg").alias("ndcg")).collect()}  # one row per combination
    best = max(combos, key=lambda c: mean[c])
    table = [(*map(float, c), float(mean[c]), c == best) for c in combos]
    return spark.createDataFrame(table, "n_estimators double, max_depth double, learning_rate double, mean_ndcg double, is_best boolean")


def rescale_scores(df: DataFrame, score: str = "score", out: str = "CPI_ML_v3") -> DataFrame:
    """Min-max to 0..100 with one digit; a constant score gives 50."""
    low, high = df.agg(F.min(score), F.max(score)).first()
    if low is None or low == high:
        return df.withColumn(out, F.when(F.col(score).isNotNull(), F.lit(50.0)))
    return df.withColumn(out, half_even((F.col(score) - low) / (high - low + 1e-9) * 100.0))


# --- contributions -------------------------------------------------------------------------------------------
def linear_contributions(df: DataFrame, weights: Mapping[str, float], means: Mapping[str, float] | None = None, key: str = "parcel_id", prefix: str = "shap_") -> DataFrame:
    """Exact Shapley values of a linear score: weight times distance from the mean."""
    if means is None:
        row = df.agg(*[F.avg(f).alias(f) for f in weights]).first()
        means = {f: row[f] or 0.0 for f in weights}
    return df.select(key, *[((F.col(f) - means[f]) * float(w)).alias(prefix + f) for f, w in weights.items()])


def group_contributions(df: DataFrame, prefix: str = "shap_") -> DataFrame:
    """Row sums of the contributions per theme."""
    return df.withColumns(
        {f"shap_groupe_{g}": add_all([F.col(prefix + f) for f in fs]) for g, fs in K.FEATURE_GROUPS.items()}
    )


def sampled_shapley(df: DataFrame, score: Scorer, features: Sequence[str], n_orders: int = 8, seed: int = 42, key: str = "parcel_id", prefix: str = "shap_") -> DataFrame:
    """Shapley values of any model by sampled feature orders, against the mean row.

    Every row is expanded to hybrids between the mean row and itself, all hybrids are scored in one pass,
    and marginal steps are averaged per row. The expansion is fixed: orders x (features + 1).
    """
    means = df.agg(*[F.avg(f).alias(f) for f in features]).first()
    rng = random.Random(seed)
    orders = [rng.sample(list(features), len(features)) for _ in range(n_orders)]
    steps = []
    for o, order in enumerate(orders):
        for i in range(len(order) + 1):
            known = set(order[:i])
            values = [F.when(F.lit(f in known), F.col(f)).otherwise(F.lit(means[f] or 0.0)).alias(f) for f in features]
            steps.append(F.struct(F.lit(o).alias("o"), F.lit(i).alias("i"), *values))
    hybrids = df.select(key, F.inline(F.array(*steps)))
    scored = score(hybrids).select(key, "o", "i", "score")
    # one row per order keeps its few scores in an array, read by position
    lines = scored.groupBy(key, "o").agg(F.array_sort(F.collect_list(F.struct("i", "score"))).alias("line"))
    cells: list[Column] = []
    for f in features:
        gain = None
        for o, order in enumerate(orders):
            i = order.index(f)
            g = F.when(F.col("o") == o, F.get("line", F.lit(i + 1))["score"] - F.get("line", F.lit(i))["score"])
            gain = g if gain is None else F.coalesce(gain, g)
        cells.append(F.avg(gain).alias(prefix + f))
    return lines.groupBy(key).agg(*cells)
