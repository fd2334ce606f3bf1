"""Stages of the batch pipeline: staged tables, the full plan, and incremental refresh."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise import catalog as K
from lotwise.functions import geometry as G
from lotwise.operators import bootstrap, cleaning, clustering, consensus, joins, labeling, models, reporting, scoring, screening, spatial
from lotwise.plans import study_area as S
from lotwise.session import is_written, materialise, write_table
from lotwise.sources import sinks

CONSENSUS_SCORES = ["CPI_v3", "cluster_score", "CPI_market", "CPI_preference"]
DEFAULT_TAU = 10.0

_staged: dict[tuple, tuple[DataFrame, str]] = {}


def stage(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Table of a pipeline stage: written once per application, read by every later step.

    It lies in the shared checkpoint folder, so it survives the loss of executors; it is written anew when
    someone has cleared that folder.
    """
    slot = (spark.sparkContext.applicationId, sf_dir, name)
    if slot not in _staged or not is_written(spark, _staged[slot][1]):
        df = build()
        path = write_table(df, name)
        _staged[slot] = (spark.read.schema(df.schema).parquet(path), path)
    return _staged[slot][0]


# --- stage 3: features -------------------------------------------------------------------------------
def build_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All feature families attached by id to all parcels; one without cells has null terrain features and is not valid."""
    terrain = S.terrain_features(spark, sf_dir)
    shape = S.parcel_shape(spark, sf_dir)
    parcels = S.parcels(spark, sf_dir)
    built = spatial.built_area(parcels, S.buildings(spark, sf_dir), S.GRID)
    ces = spatial.coverage(shape.select("parcel_id", "area_m2").join(built, "parcel_id")).select(
        "parcel_id", "ces_existant", "ces_residuel", "emprise_residuelle_m2"
    )
    flags = spatial.hazard_flags(parcels, S.hazard_points(spark, sf_dir), S.HAZARD_LAYERS, S.GRID)
    base = S.land_register(spark, sf_dir)
    out = joins.attach_features(base, [terrain.drop("surface_m2", "zone_plu"), shape.drop("area_m2"), ces, flags])
    return out.withColumn("commune", F.lit(K.COMMUNE_CODE))


def features(spark, sf_dir) -> DataFrame:
    return stage(spark, sf_dir, "features", lambda: build_features(spark, sf_dir))


# --- stage 6: validity, scores, labels, consensus --------------------------------------------------------
def with_external(spark, sf_dir, scored: DataFrame) -> DataFrame:
    """External scores by normalised id, and their consensus with our own."""
    ref = scored.select("parcel_id", F.concat(F.lit("73065AB"), F.col("parcel_id").cast("string")).alias("ref"))
    market = consensus.external_score(ref, S.market_scores(spark, sf_dir), "id_parcelle", "CPI_market", "ref")
    wish = consensus.external_score(ref, S.preference_scores(spark, sf_dir), "id_parcelle_norm", "CPI_preference", "ref")
    return joins.attach_features(scored, [market, wish])


def build_scored(spark: SparkSession, sf_dir: str, tau: float = DEFAULT_TAU) -> DataFrame:
    df = cleaning.with_validity(features(spark, sf_dir))
    out = scoring.score_parcels(df, scoring.fit_scaling(df), tau)
    sales = materialise(cleaning.prepare_sales(S.sales(spark, sf_dir)), "sales")  # read for quantiles and for medians
    labels = labeling.weak_labels(df.select("parcel_id", *K.LABEL_DEFAULTS, "cluster_score"), sales)
    out = out.join(labels.select("parcel_id", "proxy_label"), "parcel_id", "left")
    out = joins.attach_features(out, [S.model_scores(spark, sf_dir)])
    out = materialise(with_external(spark, sf_dir, out), "scores")
    merged = consensus.consensus(out, CONSENSUS_SCORES).drop("_confidence")
    return out.join(merged, "parcel_id", "left")


def scored(spark, sf_dir) -> DataFrame:
    return stage(spark, sf_dir, "scored", lambda: build_scored(spark, sf_dir))


def flagship(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    """Zonal features, validity, calibrated tau, scores, gates, and the best parcels."""
    df = cleaning.with_validity(features(spark, sf_dir))
    tau = scoring.choose_tau(df.where("is_valid"))
    best = scoring.score_parcels(df, scoring.fit_scaling(df), tau)
    cols = ["parcel_id", "CPI_v3", "CPI_v3_label", "CPI_technique", "gate_factor", "gate_reason", "slope_p90", "surface_m2"]
    return screening.ranked_top(best.where("is_valid").select(*cols), "CPI_v3", k)


def run_batch(
    spark: SparkSession, sf_dir: str, out: str, n_estimators: int = 300, runs: int = 100, restarts: int = 10, **boosting
) -> DataFrame:
    """The whole pipeline: scores, clusters, ranker, contributions, bootstrap, consensus, and every export.

    Returns the final parcel table; writes the full set, the learning set, the contributions, their
    importance and the report below ``out``.
    """
    base = cleaning.with_validity(features(spark, sf_dir))
    tau = scoring.choose_tau(base.where("is_valid"))
    df = scoring.score_parcels(base, scoring.fit_scaling(base), tau)
    sales = materialise(cleaning.prepare_sales(S.sales(spark, sf_dir)), "sales")
    labels = labeling.weak_labels(df.select("parcel_id", *K.LABEL_DEFAULTS, "cluster_score"), sales)
    df = materialise(df.join(labels.select("parcel_id", "proxy_label"), "parcel_id", "left"), "labelled")
    valid = df.where("is_valid")
    _, closeness = clustering.validate_labels(valid.drop("cluster_score"), restarts=restarts)
    df = materialise(df.drop("cluster_score").join(closeness, "parcel_id", "left"), "clustered")

    filled = cleaning.median_impute(df, K.FEATURES).withColumn("label", F.col("proxy_label"))
    learn = filled.where("is_valid and proxy_label<>-1")
    ranker = models.fit_ranker(learn, K.FEATURES, n_estimators=n_estimators)
    ranked = materialise(ranker.transform(filled.where("is_valid").select("parcel_id", *K.FEATURES)), "ranked")
    learned = models.rescale_scores(ranked).select("parcel_id", "CPI_ML_v3")
    draws = bootstrap.bootstrap_scores(learn, filled.where("is_valid"), K.FEATURES, runs, **boosting)
    df = joins.attach_intervals(joins.align_scores(df, learned, "CPI_ML_v3"), bootstrap.bootstrap_ci(draws))
    df = materialise(with_external(spark, sf_dir, df), "learned")
    df = df.join(consensus.consensus(df, CONSENSUS_SCORES).drop("_confidence"), "parcel_id", "left")
    df = materialise(df, "final")

    why = models.sampled_shapley(learn.select("parcel_id", *K.FEATURES), ranker.transform, K.FEATURES)
    why = materialise(models.group_contributions(why), "contributions")
    importance = reporting.shap_importance(why)
    sinks.sink_csv(cleaning.export_projection(df), f"{out}/parcels")
    sinks.sink_csv(cleaning.ml_dataset(df), f"{out}/learning_set")
    sinks.sink_csv(why, f"{out}/contributions")
    sinks.sink_csv(importance, f"{out}/importance")
    sinks.sink_csv(reporting.shap_group_importance(importance), f"{out}/group_importance")
    sinks.sink_csv(cleaning.drop_all_null(df.select("parcel_id", "cluster_score", "CPI_v3", "CPI_technique", "proxy_label"),
                                          ["cluster_score", "CPI_v3", "CPI_technique", "proxy_label"]), f"{out}/cluster_scores")
    sinks.sink_report_json(reporting.report_row(df, tau), f"{out}/report")
    return df


# --- incremental refresh -------------------------------------------------------------------------------
def row_hash(columns: Sequence[str]):
    """Hash of a row; a null counts by its place, so (null, 5) and (5, null) differ."""
    return F.xxhash64(*[x for c in columns for x in (F.col(c).isNull(), F.col(c))]).cast("decimal(38,0)")


def fingerprint(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Hash of all input rows of a parcel, whatever their order: count and sum of the row hashes."""
    row = row_hash(columns)
    return df.groupBy(key).agg(F.sum(row).alias("_sum"), F.count(F.lit(1)).alias("_n")).select(
        key, F.xxhash64("_sum", "_n").alias("input_hash")
    )


def incremental_refresh(
    inputs: DataFrame, columns: Sequence[str], stored: DataFrame, compute: Callable[[DataFrame], DataFrame],
    key: str = "parcel_id", options: str = "",
) -> DataFrame:
    """Reuse stored results of parcels whose inputs and options are unchanged, recompute the others.

    ``stored`` carries ``input_hash``. Parcels that vanished from the inputs vanish from the result.
    """
    now = fingerprint(inputs, key, columns).withColumn("input_hash", F.xxhash64("input_hash", F.lit(options)))
    fresh = stored.join(now, [key, "input_hash"], "left_semi")
    stale = now.join(stored.select(key, "input_hash"), [key, "input_hash"], "left_anti")
    redone = compute(inputs.join(stale.select(key), key, "left_semi")).join(stale, key)
    return fresh.withColumn("reused", F.lit(True)).unionByName(redone.withColumn("reused", F.lit(False)))


def table_fingerprint(df: DataFrame) -> int:
    """One number for a whole input table, independent of row order and partitioning."""
    row = row_hash(df.columns)
    got = df.agg(F.coalesce(F.sum(row % F.lit(10**15)), F.lit(0)).alias("s"), F.count(F.lit(1)).alias("n")).first()
    return hash((int(got["s"]), int(got["n"])))


def stale_families(
    old: Mapping[str, int], new: Mapping[str, int], inputs_of: Mapping[str, Sequence[str]] = K.FAMILY_INPUTS
) -> list[str]:
    """Families whose declared inputs changed; a missing fingerprint counts as changed."""
    changed = {name for name in {*old, *new} if old.get(name) != new.get(name)}
    return [family for family, needs in inputs_of.items() if changed.intersection(needs)]


def family_refresh(
    stored: Mapping[str, DataFrame], stale: Sequence[str], build: Mapping[str, Callable[[], DataFrame]], base: DataFrame,
    key: str = "parcel_id",
) -> DataFrame:
    """One table per family: stale ones are rebuilt, the others reused, all attached by id."""
    parts = [build[f]() if f in stale or f not in stored else stored[f] for f in build]
    return joins.attach_features(base, parts, key)


def parcel_rings(parcels: DataFrame) -> DataFrame:
    return parcels.withColumn("ring", G.rect_ring("xmin", "ymin", "xmax", "ymax"))
