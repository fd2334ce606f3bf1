"""The query suite: every operator applied to the study area, over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from lotwise import catalog as K
from lotwise.functions import geometry as G
from lotwise.functions.numeric import half_even
from lotwise.operators import (
    bootstrap, cleaning, clustering, consensus, evaluation, joins, labeling, models, raster, reporting, scoring,
    screening, spatial, terrain_flow, zonal,
)
from lotwise.operators.order_stats import grouped_quantiles
from lotwise.plans import stages as P
from lotwise.plans import study_area as S
from lotwise.session import materialise, scratch_path
from lotwise.sources import readers, sinks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

X0, Y0 = 925000.0, 6505000.0          # north-west corner of the cell grid
PROFILE_WEIGHTS = {                   # a fixed linear score, explained exactly
    "slope_p50": -0.8, "slope_p90": -0.6, "slope_std": -0.3, "twi_mean": -0.25, "has_thalweg_mean": -2.0,
    "profile_curvature_mean": 1.5, "tri_mean": -0.4, "hillshade_winter_mean": 0.9, "aspect_south_ratio_mean": 1.1,
    "svf_mean": 0.7,
}


def rounded(df: DataFrame) -> DataFrame:
    """Six digits on every floating column, ties upward, so that results compare across engines."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        out.append((F.rint((c.cast("double") + 3.7e-10) * 1e6) / 1e6 + 0.0).alias(f.name) if isinstance(f.dataType, (DoubleType, FloatType)) else c)
    return df.select(*out)


def query(name: str):
    def put(fn: Query) -> Query:
        QUERIES[name] = lambda spark, sf: rounded(fn(spark, sf))
        return fn

    return put


# --- sources and sinks ---------------------------------------------------------------------------------
@query("scan_csv")
def _(spark, sf):
    path = scratch_path(spark, "sales-csv")
    S.sales(spark, sf).write.option("header", True).csv(path)
    schema = readers.SALES_SCHEMA.replace("valeur_fonciere string", "valeur_fonciere double").replace("surface_terrain string", "surface_terrain double")
    return readers.scan_csv(spark, path, schema)


def lonlat(spark, sf) -> DataFrame:
    return S.table(spark, sf, "part").selectExpr(
        "p_partkey as id", "5.9D+(p_partkey%100)/1000.0D as lon", "45.5D+(p_partkey%77)/1000.0D as lat"
    )


@query("scan_csv_dialect")
def _(spark, sf):
    root = scratch_path(spark, "dialects")
    pts = lonlat(spark, sf)
    pts.where("id%2=0").write.option("header", True).csv(f"{root}/a")
    pts.where("id%2=1").withColumnsRenamed({"lon": "longitude", "lat": "latitude"}).write.option("header", True).option("sep", ";").csv(f"{root}/b")
    return readers.scan_csv_dialect(spark, f"{root}/*/*.csv").select("lon", "lat")


@query("scan_csv_gz")
def _(spark, sf):
    path = scratch_path(spark, "sales-gz")
    S.sales(spark, sf).write.option("header", True).option("compression", "gzip").csv(path)
    return cleaning.coerce_numeric(readers.scan_csv_gz(spark, path, readers.SALES_SCHEMA), ["valeur_fonciere", "surface_terrain"])


@query("scan_geojson")
def _(spark, sf):
    path = scratch_path(spark, "parcels-geojson")
    corner = lambda x, y: F.array(F.col(x), F.col(y))
    ring = F.array(corner("xmin", "ymin"), corner("xmax", "ymin"), corner("xmax", "ymax"), corner("xmin", "ymax"), corner("xmin", "ymin"))
    S.parcels(spark, sf).select(
        F.lit("Feature").alias("type"),
        F.struct(F.col("parcel_id").cast("string").alias("id")).alias("properties"),
        F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"),
    ).write.json(path)
    return readers.scan_geojson_lines(spark, path).select("id", G.area(F.col("ring")).alias("area_m2"))


@query("scan_points")
def _(spark, sf):
    return readers.scan_points(lonlat(spark, sf)).select("id", half_even(F.col("x"), 3).alias("x"), half_even(F.col("y"), 3).alias("y"))


@query("scan_raster_cells")
def _(spark, sf):
    path = scratch_path(spark, "cells")
    S.cells(spark, sf).selectExpr("r", "c", f"coalesce(z,{K.NODATA}D) z", "concat('t', cast(r div 100 as string)) tile_id").write.partitionBy("tile_id").parquet(path)
    return readers.scan_raster_cells(spark, path).select("r", "c", "z", "tile_id")


@query("stage_snapshot")
def _(spark, sf):
    stored = materialise(P.features(spark, sf), "snapshot")
    return S.parcels(spark, sf).select("parcel_id").join(stored.select("parcel_id", "slope_p90", "twi_mean", "block_id"), "parcel_id", "left")


@query("sink_csv")
def _(spark, sf):
    path = scratch_path(spark, "export-csv")
    out = cleaning.export_projection(P.scored(spark, sf))
    sinks.sink_csv(out, path)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in out.schema.fields)
    return sinks.read_back_csv(spark, path, schema).select("parcel_id", "CPI_v3", "gate_reason", "shape_warning", "cluster_score")


@query("sink_report_json")
def _(spark, sf):
    path = scratch_path(spark, "report-json")
    report = reporting.report_row(P.scored(spark, sf), P.DEFAULT_TAU)
    sinks.sink_report_json(report, path)
    back = spark.read.schema(report.schema).json(path)
    return back.select(
        "n_total", "n_valid", "n_labeled", "n_pos", "n_neg", "n_blocks", F.col("cpi_v3_stats.mean").alias("cpi_mean"),
        F.col("cpi_v3_stats.std").alias("cpi_std"), F.col("shape_metrics.median_compactness").alias("median_compactness"),
        F.col("ces_metrics.n_viable_80m2").alias("n_viable_80m2"), "tau_softmin",
    )


@query("unify_sources")
def _(spark, sf):
    s = S.sales(spark, sf).withColumn("part", F.expr("cast(id_parcelle as bigint)%3"))
    a = s.where("part=0").drop("part")
    b = s.where("part=1").select(
        F.col("id_parcelle").alias("Code_Parcelle"), F.col("valeur_fonciere").alias("Valeur fonciere"),
        F.col("surface_terrain").alias("Surface terrain"), F.col("nature_mutation").alias("Nature mutation"), F.col("code_commune").alias("l_codinsee"),
    )
    c = s.where("part=2").select(F.col("id_parcelle").alias("CODE_PARCELLE"), F.col("valeur_fonciere").alias("VALEUR_FONCIERE_EUR"))
    return cleaning.coerce_numeric(readers.unify_sources([a, b, c]), ["valeur_fonciere", "surface_terrain"])


# --- cleaning --------------------------------------------------------------------------------------------
@query("coerce_numeric")
def _(spark, sf):
    raw = S.table(spark, sf, "lineitem").selectExpr(
        "l_partkey", "case when l_linenumber=3 then 'n/a' when l_linenumber=4 then '' else cast(l_quantity as string) end surface"
    )
    return cleaning.coerce_numeric(raw, ["surface"])


@query("filter_sales")
def _(spark, sf):
    raw = S.sales(spark, sf).withColumn("nature_mutation", F.when(F.col("surface_terrain") != 13, F.col("nature_mutation")))
    return cleaning.sales_only(raw)


@query("price_per_m2")
def _(spark, sf):
    return cleaning.price_per_m2(S.sales(spark, sf))


@query("commune_filter_fallback")
def _(spark, sf):
    return cleaning.prepare_sales(S.sales(spark, sf)).select("id_parcelle", "prix_m2", "code_commune")


@query("commune_from_id")
def _(spark, sf):
    raw = S.sales(spark, sf).drop("code_commune").withColumn("id_parcelle", F.concat(F.lit("7306"), F.col("id_parcelle")))
    return cleaning.commune_of(raw).select("id_parcelle", F.col("_commune").alias("commune_code"))


@query("valid_geometry")
def _(spark, sf):
    p = P.parcel_rings(S.parcels(spark, sf))
    k = F.col("parcel_id") % 10
    flat = G.rect_ring("xmin", "ymin", "xmin", "ymax")
    ring = F.when(k == 0, F.slice("ring", 1, 0)).when(k == 1, flat).when(k == 2, F.slice("ring", 1, 4)).otherwise(F.col("ring"))
    return cleaning.valid_geometry(p.withColumn("ring", ring)).select("parcel_id")


@query("nan_ratio")
def _(spark, sf):
    return cleaning.with_validity(P.features(spark, sf)).select("parcel_id", "nan_ratio")


@query("is_valid")
def _(spark, sf):
    return cleaning.with_validity(P.features(spark, sf)).select("parcel_id", "is_valid")


@query("filter_counters")
def _(spark, sf):
    return cleaning.filter_counters(cleaning.with_validity(P.features(spark, sf)))


@query("median_impute")
def _(spark, sf):
    return cleaning.median_impute(P.features(spark, sf), K.FEATURES).select("parcel_id", *K.FEATURES)


@query("default_fill")
def _(spark, sf):
    holes = P.features(spark, sf).withColumns({c: F.when(F.col("parcel_id") % 9 != i, F.col(c)) for i, c in enumerate(K.LABEL_DEFAULTS)})
    return cleaning.default_fill(holes).select("parcel_id", *K.LABEL_DEFAULTS)


@query("normalize_parcel_id")
def _(spark, sf):
    return cleaning.normalize_parcel_id(S.market_scores(spark, sf), "id_parcelle").select("id_parcelle", "id_padded", "id_compact", "id_sale")


@query("normalize_zone")
def _(spark, sf):
    return cleaning.normalize_zone(S.zones(spark, sf), "typezone").select("zone_id", "zone_norm")


@query("bbox_filter")
def _(spark, sf):
    return cleaning.bbox_filter(S.parcels(spark, sf), (926000.0, 6500000.0, 927500.0, 6502000.0))


@query("feature_availability")
def _(spark, sf):
    df = P.features(spark, sf).withColumn("tri_mean", F.lit(None).cast("double")).drop("svf_mean")
    return cleaning.feature_availability(df)


@query("drop_all_null")
def _(spark, sf):
    cols = ["cluster_score", "CPI_ML_v3", "CPI_market", "CPI_preference"]
    return cleaning.drop_all_null(P.scored(spark, sf), cols).select("parcel_id", *cols)


@query("export_projection")
def _(spark, sf):
    return cleaning.export_projection(P.scored(spark, sf))


@query("ml_dataset")
def _(spark, sf):
    return cleaning.ml_dataset(P.scored(spark, sf))


@query("parcel_id_coalesce")
def _(spark, sf):
    df = S.parcels(spark, sf).selectExpr(
        "parcel_id", "case when parcel_id%3=0 then concat('P', cast(parcel_id as string)) end named",
        "case when parcel_id%5=0 then concat('G', cast(parcel_id as string)) end geom_id",
    )
    return cleaning.parcel_id_coalesce(df, "named", "geom_id", "parcel_id").select("parcel_id", "parcel_key")


# --- joins ---------------------------------------------------------------------------------------------
@query("spatial_left_join")
def _(spark, sf):
    return spatial.spatial_left_join(S.parcels(spark, sf), S.zones(spark, sf), S.GRID)


@query("zone_assign")
def _(spark, sf):
    return spatial.assign_zone(S.parcels(spark, sf), S.zones(spark, sf), "typezone", S.GRID)


@query("hazard_flag")
def _(spark, sf):
    return spatial.hazard_flags(S.parcels(spark, sf), S.hazard_points(spark, sf), S.HAZARD_LAYERS, S.GRID)


@query("overlay_built_area")
def _(spark, sf):
    return spatial.built_area(S.parcels(spark, sf), S.buildings(spark, sf), S.GRID)


@query("price_lookup")
def _(spark, sf):
    return labeling.price_lookup(P.features(spark, sf).select("parcel_id"), cleaning.prepare_sales(S.sales(spark, sf)))


@query("align_scores")
def _(spark, sf):
    return joins.align_scores(S.parcels(spark, sf).select("parcel_id"), S.model_scores(spark, sf), "CPI_ML_v3")


@query("attach_features")
def _(spark, sf):
    return P.build_features(spark, sf).select(
        "parcel_id", "slope_p50", "compactness_ratio", "ces_existant", "brgm_argiles_flag", "block_id"
    )


@query("score_align_concat")
def _(spark, sf):
    ids = S.parcels(spark, sf).select("parcel_id")
    scored = P.scored(spark, sf)
    return joins.attach_features(ids, [scored.select("parcel_id", c) for c in P.CONSENSUS_SCORES])


@query("external_score_map")
def _(spark, sf):
    ids = P.features(spark, sf).select("parcel_id")
    return P.with_external(spark, sf, ids)


def shap(spark, sf) -> DataFrame:
    filled = cleaning.median_impute(P.scored(spark, sf), K.FEATURES).where("is_valid and proxy_label<>-1")
    return models.linear_contributions(filled, PROFILE_WEIGHTS)


@query("ci_enrich")
def _(spark, sf):
    return joins.attach_intervals(shap(spark, sf).select("parcel_id", "shap_slope_p90"), S.model_scores(spark, sf))


@query("geometry_join")
def _(spark, sf):
    geometry = S.parcels(spark, sf).withColumn("surface_m2", F.lit(-1.0))
    kept = screening.screen(P.scored(spark, sf)).select("parcel_id", "CPI_technique", "surface_m2")
    return joins.geometry_join(kept, geometry)


@query("semi_join_ids")
def _(spark, sf):
    return joins.semi_join_ids(P.features(spark, sf).select("parcel_id", "slope_p90"), shap(spark, sf))


@query("nearest_road_distance")
def _(spark, sf):
    pts = S.parcels(spark, sf).select("parcel_id", ((F.col("xmin") + F.col("xmax")) / 2).alias("px"), ((F.col("ymin") + F.col("ymax")) / 2).alias("py"))
    return spatial.nearest_segment_distance(pts, S.roads(spark, sf), 250.0)


def raster_zones(spark, sf) -> DataFrame:
    """Rectangles cut from the cell grid."""
    k = S.table(spark, sf, "part").selectExpr("p_partkey as k", "(p_partkey*7)%46 c0", "(p_partkey*3) div 20 r0")
    z = k.selectExpr(
        "k as zone_id", f"{X0}D+c0*0.5D xmin", f"{Y0}D-(r0+3+k%7)*0.5D ymin", f"{X0}D+(c0+3+k%5)*0.5D xmax", f"{Y0}D-r0*0.5D ymax"
    )
    return z.withColumn("ring", G.rect_ring("xmin", "ymin", "xmax", "ymax"))


def placed_cells(spark, sf) -> DataFrame:
    return zonal.with_centres(S.cells(spark, sf), X0, Y0)


def members(spark, sf) -> DataFrame:
    return zonal.cells_in_polygons(placed_cells(spark, sf), raster_zones(spark, sf), "zone_id")


@query("cell_in_polygon_join")
def _(spark, sf):
    return members(spark, sf).select("zone_id", "r", "c")


@query("buffer_zonal")
def _(spark, sf):
    zones = raster_zones(spark, sf)
    near = zonal.cells_within(placed_cells(spark, sf), zones.drop("ring"), K.HEIGHT_BUFFER_M, "zone_id")
    return zonal.zonal_stats(zones, near, "z", "height_obj", ["max", "mean"], "zone_id")


@query("compare_pairs")
def _(spark, sf):
    pairs = S.table(spark, sf, "part").selectExpr("p_partkey as id_a", "p_partkey+1 as id_b")
    return joins.compare_pairs(P.scored(spark, sf), pairs)


# --- geometry --------------------------------------------------------------------------------------------
def ring_shapes(spark, sf) -> DataFrame:
    return S.shape_of(P.parcel_rings(S.parcels(spark, sf)))


for _name, _cols in {
    "geom_area": ["area_m2"], "geom_perimeter": ["perimeter_m"], "geom_centroid": ["cx", "cy"],
    "compactness": ["compactness_ratio"], "elongation": ["elongation_ratio"], "block_id": ["block_id"],
}.items():
    query(_name)(lambda spark, sf, cols=_cols: ring_shapes(spark, sf).select("parcel_id", *cols))


@query("geom_bounds")
def _(spark, sf):
    p = P.parcel_rings(S.parcels(spark, sf).selectExpr("parcel_id", "xmax as xmin", "ymax as ymin", "xmin as xmax", "ymin as ymax"))
    return p.select("parcel_id", F.inline(F.array(G.bounds(F.col("ring")))))


@query("to_lambert93")
def _(spark, sf):
    pts = S.table(spark, sf, "orders").selectExpr("o_orderkey as id", "(o_orderkey%1000)/100.0D-2.0D lon", "42.0D+(o_orderkey%877)/100.0D lat")
    xy = pts.withColumn("p", G.to_lambert93(F.col("lon"), F.col("lat")))
    return xy.select("id", half_even(F.col("p.x"), 3).alias("x"), half_even(F.col("p.y"), 3).alias("y"))


# --- raster ------------------------------------------------------------------------------------------------
@query("mosaic")
def _(spark, sf):
    c = S.cells(spark, sf)
    a = c.select("r", "c", F.when((F.col("r") + F.col("c")) % 7 != 0, F.col("z")).alias("z"), F.lit(1).alias("tile_order"))
    b = c.where("r%2=0").select("r", "c", (F.col("z") + 1000).alias("z"), F.lit(2).alias("tile_order"))
    return raster.mosaic(a.unionByName(b))


@query("raster_profile")
def _(spark, sf):
    return raster.raster_profile(S.cells(spark, sf), K.CELL_SIZE_M)


@query("slope_horn")
def _(spark, sf):
    return raster.slope(S.cells(spark, sf)).select("r", "c", "slope_deg")


@query("tri_riley")
def _(spark, sf):
    return raster.tri_riley(S.cells(spark, sf))


@query("hillshade_winter")
def _(spark, sf):
    return raster.hillshade_winter(S.cells(spark, sf))


@query("aspect_south")
def _(spark, sf):
    return raster.aspect_south(S.cells(spark, sf))


@query("curvature_laplacian")
def _(spark, sf):
    return raster.curvature(S.cells(spark, sf))


WIDE = 50.0  # cell size at which part of the synthetic terrain is flat


def flat(spark, sf) -> DataFrame:
    return raster.flat_mask(raster.slope(S.cells(spark, sf), WIDE))


@query("flat_mask")
def _(spark, sf):
    return flat(spark, sf).select("r", "c", "flat")


@query("flat_components")
def _(spark, sf):
    return terrain_flow.flat_components(flat(spark, sf))


@query("fill_depressions")
def _(spark, sf):
    return terrain_flow.fill_depressions(S.cells(spark, sf))


def drained(spark, sf) -> DataFrame:
    """Drainage of the filled surface: what flows into a pit leaves it again."""
    return terrain_flow.flow_accumulation(terrain_flow.d8_pointers(terrain_flow.fill_depressions(S.cells(spark, sf))))


def _accumulation(spark, sf):
    return drained(spark, sf).select("r", "c", "accumulation")


def _twi(spark, sf):
    both = raster.slope(S.cells(spark, sf)).join(drained(spark, sf).drop("z"), ["r", "c"])
    return raster.twi(both).select("r", "c", "twi")


def _thalweg(spark, sf):
    return raster.thalweg_mask(drained(spark, sf)).select("r", "c", "thalweg")


for _name, _fn in {"flow_accumulation_d8": _accumulation, "twi": _twi, "thalweg_mask": _thalweg}.items():
    query(_name)(_fn)
    query(f"{_name}_filled")(_fn)  # the name under which the filled surface was drained first


@query("sky_view_factor")
def _(spark, sf):
    return terrain_flow.sky_view_factor(S.cells(spark, sf), WIDE)


@query("raster_summary")
def _(spark, sf):
    return raster.raster_summary(flat(spark, sf), "flat")


# --- zonal and aggregates ------------------------------------------------------------------------------------
@query("zonal_stats")
def _(spark, sf):
    return zonal.zonal_stats(raster_zones(spark, sf), members(spark, sf), "z", "z", key="zone_id")


@query("zonal_percentiles")
def _(spark, sf):
    return zonal.zonal_percentiles(raster_zones(spark, sf), members(spark, sf), "z", "z", key="zone_id")


@query("zonal_lineitem")
def _(spark, sf):
    li = S.table(spark, sf, "lineitem").select("l_partkey", "l_quantity", "l_extendedprice")
    return grouped_quantiles(
        li, ["l_partkey"], [(F.col("l_extendedprice"), {"price_p50": 0.5, "price_p90": 0.9})],
        [F.avg("l_quantity").alias("qty_mean"), F.max("l_quantity").alias("qty_max"), F.min("l_quantity").alias("qty_min"),
         F.stddev_pop("l_quantity").alias("qty_std"), F.count("l_quantity").alias("qty_count")],
    )


@query("flat_area")
def _(spark, sf):
    placed = zonal.with_centres(flat(spark, sf).select("r", "c", "flat"), X0, Y0)
    zones = raster_zones(spark, sf).withColumn("area_m2", G.area(F.col("ring")))
    inside = zonal.cells_in_polygons(placed, zones, "zone_id")
    return zonal.flat_area(zones, inside, "zone_id")


@query("ces_residual")
def _(spark, sf):
    p = S.parcels(spark, sf)
    areas = S.parcel_shape(spark, sf).select("parcel_id", "area_m2").join(spatial.built_area(p, S.buildings(spark, sf), S.GRID), "parcel_id")
    return spatial.coverage(areas).select("parcel_id", "ces_existant", "ces_residuel", "emprise_residuelle_m2")


def clean_sales(spark, sf) -> DataFrame:
    return cleaning.prepare_sales(S.sales(spark, sf))


@query("group_median_price")
def _(spark, sf):
    return labeling.median_price_per_id(clean_sales(spark, sf))


@query("price_quantiles")
def _(spark, sf):
    q = labeling.price_quantiles(clean_sales(spark, sf))
    return clean_sales(spark, sf).agg(F.count(F.lit(1)).alias("n_sales")).select(
        "n_sales", *[F.lit(v).cast("double").alias(n) for n, v in q.items()]
    )


@query("block_balance")
def _(spark, sf):
    return labeling.block_balance(P.scored(spark, sf))


@query("block_classes")
def _(spark, sf):
    return labeling.block_classes(labeling.block_balance(P.scored(spark, sf)))


@query("distinct_blocks")
def _(spark, sf):
    return reporting.distinct_blocks(S.parcel_shape(spark, sf))


@query("score_summary")
def _(spark, sf):
    return reporting.score_summary(P.scored(spark, sf))


@query("zone_distribution")
def _(spark, sf):
    return reporting.zone_distribution(P.features(spark, sf))


@query("layer_zone_counts")
def _(spark, sf):
    z = S.zones(spark, sf).withColumn("Libelle", F.when(F.col("zone_id") % 2 == 0, F.lit(" au x"))).withColumnRenamed("typezone", "TypeZone")
    return reporting.layer_zone_counts(z)


@query("shape_ces_metrics")
def _(spark, sf):
    return reporting.shape_coverage_metrics(P.scored(spark, sf))


@query("label_distribution")
def _(spark, sf):
    final = reporting.label_distribution(P.scored(spark, sf), "CPI_v3_label", [l for _, l in K.LADDER_FINAL])
    tech = reporting.label_distribution(P.scored(spark, sf), "CPI_technique_label", [l for _, l in K.LADDER_TECHNICAL])
    return final.withColumn("score", F.lit("CPI_v3")).unionByName(tech.withColumn("score", F.lit("CPI_technique")))


@query("corr_matrix")
def _(spark, sf):
    return reporting.corr_matrix(P.scored(spark, sf), ["CPI_v3", "CPI_technique", "consensus_score", "cluster_score", "CPI_ML_v3"])


@query("spearman")
def _(spark, sf):
    return evaluation.spearman(P.scored(spark, sf), "CPI_v3", "CPI_ML_v3", ["zone_plu"])


@query("score_gap")
def _(spark, sf):
    return evaluation.score_gap(P.scored(spark, sf))


def ranking_input(spark, sf) -> DataFrame:
    """Labelled valid parcels with a fixed score, fold and prediction."""
    d = P.scored(spark, sf).where("is_valid and proxy_label<>-1")
    return d.select(
        "parcel_id", "block_id", F.col("proxy_label").alias("label"), F.col("CPI_v3").alias("score"),
        (F.col("parcel_id") % 5).cast("int").alias("fold"), (F.col("CPI_v3") >= 45).cast("int").alias("predicted"), "CPI_ML_v3",
    )


@query("confusion_matrix")
def _(spark, sf):
    return evaluation.confusion_matrix(ranking_input(spark, sf))


@query("shap_importance")
def _(spark, sf):
    return reporting.shap_importance(shap(spark, sf))


@query("shap_group_importance")
def _(spark, sf):
    return reporting.shap_group_importance(reporting.shap_importance(shap(spark, sf)))


@query("histogram")
def _(spark, sf):
    a = reporting.histogram(P.scored(spark, sf), "CPI_technique").withColumn("score", F.lit("CPI_technique"))
    b = reporting.histogram(P.scored(spark, sf), "cpi_ml_std").withColumn("score", F.lit("cpi_ml_std"))
    return a.unionByName(b)


def clustered(spark, sf) -> DataFrame:
    """Valid parcels with a given cluster, so that what follows clustering can be compared exactly."""
    return P.scored(spark, sf).where("is_valid").withColumn("cluster_id", (F.col("parcel_id") % 4).cast("int"))


@query("cluster_profile")
def _(spark, sf):
    return clustering.cluster_profile(clustered(spark, sf))


# --- scoring ---------------------------------------------------------------------------------------------
@query("robust_normalize")
def _(spark, sf):
    df = P.features(spark, sf).withColumn("flat_col", F.lit(3.0))
    s = scoring.fit_raw_scaling(df, ["slope_p50", "twi_mean", "flat_col"])
    return df.select(
        "parcel_id", scoring.normalized(s, "slope_p50").alias("slope_norm"), scoring.normalized(s, "twi_mean", True).alias("twi_inverted"),
        scoring.normalized(s, "flat_col", True).alias("constant_norm"),
    )


@query("sigmoid_stretch")
def _(spark, sf):
    df = P.features(spark, sf)
    s = scoring.fit_raw_scaling(df, ["slope_p90", "twi_mean"])
    return df.select(
        "parcel_id", scoring.normalized(s, "slope_p90", False, True).alias("slope_stretch"),
        scoring.normalized(s, "twi_mean", True, True).alias("twi_stretch"),
    )


def validated(spark, sf) -> DataFrame:
    return cleaning.with_validity(P.features(spark, sf))


@query("group_scores")
def _(spark, sf):
    df = validated(spark, sf)
    return scoring.group_scores(df, scoring.fit_scaling(df)).select("parcel_id", *scoring.GROUP_COLUMNS.values())


@query("group_scores_no_svf")
def _(spark, sf):
    df = validated(spark, sf).drop("svf_mean")
    return scoring.group_scores(df, scoring.fit_scaling(df)).select("parcel_id", "score_soleil")


def tau_groups(spark, sf) -> DataFrame:
    valid = validated(spark, sf).where("is_valid")
    return scoring.tau_group_scores(valid, scoring.fit_scaling(valid, K.FEATURES)).select("parcel_id", "p", "h", "m", "s")


@query("tau_group_scores")
def _(spark, sf):
    return tau_groups(spark, sf)


@query("softmin")
def _(spark, sf):
    cols = [F.col(c) for c in scoring.GROUP_COLUMNS.values()]
    return P.scored(spark, sf).select("parcel_id", *[scoring.softmin(cols, t).alias(f"softmin_{n}") for n, t in (("small", 0.5), ("mid", 10.0), ("large", 100.0))])


@query("calibrate_tau_curve")
def _(spark, sf):
    return scoring.tau_std_curve(tau_groups(spark, sf), [0.5, 1.0, 2.0, 5.0, 10.0, 20.0, 50.0, 100.0])


@query("calibrate_tau")
def _(spark, sf):
    groups = materialise(tau_groups(spark, sf), "tau-groups")
    target = 14.3
    tau = scoring.calibrate_tau(groups, target)
    return groups.agg(F.count(F.lit(1)).alias("n")).select("n", F.lit(tau).alias("tau"))


def _scored_columns(*cols):
    def run(spark, sf):
        df = validated(spark, sf)
        return scoring.score_parcels(df, scoring.fit_scaling(df), P.DEFAULT_TAU).select("parcel_id", *cols)

    return run


for _name, _cols in {
    "cpi_raw": ["score_continu", "score_softmin", "cpi_brut"],
    "gates": ["gate_factor", "gate_reason"],
    "cpi_final": ["CPI_v3", "CPI_v3_label"],
    "cpi_technique": ["CPI_technique", "CPI_technique_label"],
    "cpi_valeur": ["CPI_valeur", "CPI_valeur_label"],
    "shape_warning": ["shape_warning"],
    "ces_warning": ["ces_warning"],
}.items():
    query(_name)(_scored_columns(*_cols))


@query("viewer_labels")
def _(spark, sf):
    return scoring.viewer_labels(P.scored(spark, sf)).select("parcel_id", "viewer_label", "viewer_colour", "confidence_mark")


@query("flagship_top_parcels")
def _(spark, sf):
    return P.flagship(spark, sf)


# --- weak labels, clusters ---------------------------------------------------------------------------------
@query("lf_terrain")
def _(spark, sf):
    return labeling.terrain_votes(P.features(spark, sf)).select("parcel_id", "h1", "h2")


@query("lf_market")
def _(spark, sf):
    return labeling.market_votes(P.features(spark, sf).select("parcel_id"), materialise(clean_sales(spark, sf), "sales")).select("parcel_id", "h3", "h4")


@query("lf_cluster")
def _(spark, sf):
    df = P.features(spark, sf)
    on = labeling.clusters_available(df)
    return labeling.cluster_votes(df).select("parcel_id", "h5_pos", "h5_neg", F.lit(on).alias("available"))


@query("weak_label_vote")
def _(spark, sf):
    df = P.features(spark, sf)
    sales = materialise(clean_sales(spark, sf), "sales")
    with_h5 = labeling.weak_labels(df, sales).select("parcel_id", "proxy_label")
    without = labeling.weak_labels(df, sales, None).select("parcel_id", F.col("proxy_label").alias("label_without_clusters"))
    return with_h5.join(without, "parcel_id")


@query("standard_scale")
def _(spark, sf):
    cols = ["slope_p50", "twi_mean", "tri_mean", "flat_col"]
    df = cleaning.median_impute(P.scored(spark, sf).where("is_valid").withColumn("flat_col", F.lit(3.0)), cols)
    return clustering.standard_scale(df, cols).select("parcel_id", *[f"z_{c}" for c in cols])


@query("kmeans4")
def _(spark, sf):
    rows, _, _ = clustering.kmeans4(P.scored(spark, sf).where("is_valid"), K.FEATURES)
    return rows


@query("validate_labels")
def _(spark, sf):
    agreement, _ = clustering.validate_labels(P.scored(spark, sf).where("is_valid"))
    return agreement


@query("cluster_constructibility")
def _(spark, sf):
    return clustering.constructibility(materialise(clustering.cluster_profile(clustered(spark, sf)), "profile")).select("cluster_id", "constructibility_score")


def _ends(spark, sf):
    return clustering.best_and_worst(clustering.constructibility(materialise(clustering.cluster_profile(clustered(spark, sf)), "profile")))


@query("cluster_agreement")
def _(spark, sf):
    best, worst = _ends(spark, sf)
    return clustering.cluster_agreement(clustered(spark, sf), best, worst)


@query("cluster_score")
def _(spark, sf):
    cols = clustering.PROFILE_COLUMNS
    df = clustering.standard_scale(cleaning.median_impute(clustered(spark, sf), cols), cols)
    centre = df.groupBy("cluster_id").agg(*[F.avg(f"z_{c}").alias(c) for c in cols])
    rows = {r["cluster_id"]: [r[c] for c in cols] for r in centre.collect()}  # one row per cluster
    best, worst = _ends(spark, sf)
    return clustering.cluster_score(df, [f"z_{c}" for c in cols], rows[best], rows[worst])


@query("cluster_order")
def _(spark, sf):
    ranked = clustering.constructibility(materialise(clustering.cluster_profile(clustered(spark, sf)), "profile"))
    return ranked.orderBy(F.col("constructibility_score").desc(), "cluster_id").limit(2).select("cluster_id")


@query("pooled_union")
def _(spark, sf):
    best, worst = _ends(spark, sf)
    c = clustered(spark, sf)
    pos = c.where("proxy_label=1").select((F.col("cluster_id") == best).alias("hit"))
    neg = c.where("proxy_label=0").select((F.col("cluster_id") == worst).alias("hit"))
    return pos.unionByName(neg).agg((F.avg(F.col("hit").cast("double")) * 100.0).alias("agreement"), F.count(F.lit(1)).alias("n"))


# --- folds, metrics, models, bootstrap ----------------------------------------------------------------------
def model_input(spark, sf) -> DataFrame:
    filled = cleaning.median_impute(P.scored(spark, sf), K.FEATURES).where("is_valid and proxy_label<>-1")
    cols = filled.select("parcel_id", "block_id", *K.FEATURES, F.col("proxy_label").alias("label"), "CPI_v3")
    return materialise(evaluation.group_kfold(cols), "model-input")


@query("group_kfold")
def _(spark, sf):
    d = P.scored(spark, sf).where("is_valid and proxy_label<>-1").select("parcel_id", "block_id")
    return evaluation.group_kfold(d).select("parcel_id", "block_id", "fold")


FOLDS = range(5)


@query("model_logistic")
def _(spark, sf):
    cv = models.cross_validate(model_input(spark, sf), lambda d: models.fit_logistic(d, K.FEATURES), "logistic", FOLDS)
    return evaluation.fold_metrics(materialise(cv, "cv"), 20, "CPI_v3")


@query("model_forest")
def _(spark, sf):
    cv = models.cross_validate(model_input(spark, sf), lambda d: models.fit_forest(d, K.FEATURES), "forest", FOLDS)
    return evaluation.fold_metrics(materialise(cv, "cv"), 20, "CPI_v3")


@query("model_ranker")
def _(spark, sf):
    """Scores of every labelled parcel by the ranker of the other folds; each fold has a model, so a scale, of its own."""
    cv = models.cross_validate_ranker(model_input(spark, sf), K.FEATURES, FOLDS)
    cv = cv.select("parcel_id", F.col("label").cast("int").alias("label"), "fold", "score")
    scaled = [models.rescale_scores(cv.where(F.col("fold") == f)) for f in FOLDS]
    return reduce(DataFrame.unionByName, scaled).select("parcel_id", "label", "fold", "score", "CPI_ML_v3")


@query("ranking_gradients")
def _(spark, sf):
    d = ranking_input(spark, sf).select("parcel_id", "block_id", "label", "score", "fold")
    return models.ranking_gradients(d.withColumn("score", F.col("score") / 10.0), "fold").select("parcel_id", "grad", "hess")


@query("grid_search")
def _(spark, sf):
    return models.grid_search(model_input(spark, sf), K.FEATURES, models.RANKER_GRID, FOLDS)


@query("ndcg_at_k")
def _(spark, sf):
    return evaluation.ndcg_at_k(ranking_input(spark, sf))


@query("precision_at_k")
def _(spark, sf):
    return evaluation.precision_at_k(ranking_input(spark, sf))


@query("auc")
def _(spark, sf):
    return evaluation.auc(ranking_input(spark, sf))


@query("model_comparison")
def _(spark, sf):
    d = ranking_input(spark, sf)
    two = d.withColumn("model", F.lit("rules")).unionByName(
        d.withColumn("model", F.lit("ranker")).withColumn("score", F.coalesce("CPI_ML_v3", F.lit(0.0)))
    )
    return evaluation.model_comparison(evaluation.fold_metrics(two))


def final_ranker(spark, sf) -> tuple[DataFrame, models.Ranker]:
    """All valid parcels with their gaps filled, and the ranker fitted on the labelled ones among them."""
    cols = ["parcel_id", "block_id", "proxy_label", *K.FEATURES]
    filled = materialise(cleaning.median_impute(P.scored(spark, sf), K.FEATURES).where("is_valid").select(*cols), "final-input")
    return filled, models.fit_ranker(filled.where("proxy_label<>-1"), K.FEATURES, label="proxy_label")


@query("ml_score")
def _(spark, sf):
    filled, ranker = final_ranker(spark, sf)
    return models.rescale_scores(materialise(ranker.transform(filled), "ml")).select("parcel_id", "CPI_ML_v3")


@query("shap_values_trees")
def _(spark, sf):
    """Exact Shapley values of the final ranker for the labelled parcels."""
    filled, ranker = final_ranker(spark, sf)
    return ranker.model.contributions(filled.where("proxy_label<>-1"), ["parcel_id"])


@query("model_checks")
def _(spark, sf):
    """What holds for any fit: rows scored once, scales, blocks in one fold, one best combination, contributions that add up."""
    rows, ranked = model_input(spark, sf), QUERIES["model_ranker"](spark, sf)
    filled, ranker = final_ranker(spark, sf)
    learned = filled.where("proxy_label<>-1")
    parts = ranker.model.contributions(learned, ["parcel_id"]).join(ranker.transform(learned.select("parcel_id", *K.FEATURES)).select("parcel_id", "score"), "parcel_id")
    total = reduce(lambda x, y: x + y, [F.col(f"shap_{f}") for f in K.FEATURES])
    valid = models.rescale_scores(ranker.transform(filled))
    found = {
        "ranker_rows": ranked.count(), "ranker_parcels": ranked.select("parcel_id").distinct().count(), "folds": ranked.select("fold").distinct().count(),
        "outside_0_100": ranked.where("not CPI_ML_v3 between 0 and 100").count(),
        "blocks_in_two_folds": rows.groupBy("block_id").agg(F.countDistinct("fold").alias("n")).where("n > 1").count(),
        "final_scores": valid.where("CPI_ML_v3 between 0 and 100").count(),
        "contributions_that_add_up": parts.where(F.abs(total - (F.col("score") - ranker.model.expected())) < 1e-6).count(),
    }
    return spark.createDataFrame(list(found.items()), "check string, n long")


@query("rescale_scores")
def _(spark, sf):
    d = P.features(spark, sf).where("twi_mean is not null").select("parcel_id", F.col("twi_mean").alias("score"))
    return models.rescale_scores(d).select("parcel_id", "CPI_ML_v3")


@query("shap_values")
def _(spark, sf):
    return shap(spark, sf)


@query("shap_values_sampled")
def _(spark, sf):
    d = model_input(spark, sf)
    return models.sampled_shapley(d, models.fit_forest(d, K.FEATURES), K.FEATURES)


@query("shap_groups")
def _(spark, sf):
    return models.group_contributions(shap(spark, sf)).select("parcel_id", *[f"shap_groupe_{g}" for g in K.FEATURE_GROUPS])


@query("bootstrap_resample")
def _(spark, sf):
    d = P.scored(spark, sf).where("is_valid and proxy_label<>-1").select("parcel_id")
    drawn = bootstrap.bootstrap_weights(d, 100)
    return drawn.groupBy("run").agg(F.sum("weight").alias("drawn"), F.count(F.lit(1)).alias("n_distinct"), F.sum(F.col("weight") * F.col("parcel_id")).alias("checksum"))


@query("bootstrap_ci_fitted")
def _(spark, sf):
    filled = materialise(cleaning.median_impute(P.scored(spark, sf).where("is_valid"), K.FEATURES).select("parcel_id", "proxy_label", *K.FEATURES), "boot-in")
    long = bootstrap.bootstrap_scores(filled.where("proxy_label<>-1"), filled, K.FEATURES)
    return bootstrap.bootstrap_ci(long)


def given_runs(spark, sf) -> DataFrame:
    """Scores of forty runs as arithmetic on the parcels, so the aggregation can be compared exactly."""
    runs = F.explode(F.sequence(F.lit(0), F.lit(39))).alias("run")
    return P.features(spark, sf).select("parcel_id", "slope_p50", runs).select(
        "run", "parcel_id", F.expr("((parcel_id*31+run*run*17+run*7)%1009)/1009.0D*least(slope_p50,30D)+40.0D").alias("p")
    )


@query("bootstrap_ci")
def _(spark, sf):
    return bootstrap.bootstrap_ci(given_runs(spark, sf))


@query("ci_stability")
def _(spark, sf):
    return bootstrap.ci_stability(bootstrap.bootstrap_ci(given_runs(spark, sf)))


# --- ranks and consensus -----------------------------------------------------------------------------------
@query("pct_rank_avg")
def _(spark, sf):
    return consensus.pct_ranks(P.scored(spark, sf), P.CONSENSUS_SCORES).select("parcel_id", "score", "pct_rank")


@query("consensus")
def _(spark, sf):
    return consensus.consensus(P.scored(spark, sf), P.CONSENSUS_SCORES).drop("_confidence")


@query("consensus_meta")
def _(spark, sf):
    df = P.scored(spark, sf)
    merged = materialise(consensus.consensus(df, P.CONSENSUS_SCORES), "consensus")
    return consensus.consensus_meta(merged, df, P.CONSENSUS_SCORES)


@query("top_k")
def _(spark, sf):
    return screening.top_k(P.scored(spark, sf).where("is_valid"), "CPI_ML_v3", 5).select(
        "parcel_id", "CPI_ML_v3", "CPI_v3", "slope_p50", "slope_p90", "svf_mean", "twi_mean", "surface_m2"
    )


@query("ranked_top10")
def _(spark, sf):
    kept = screening.screen(P.scored(spark, sf)).select("parcel_id", "CPI_technique", "consensus_confidence", "slope_p90", "surface_m2")
    return screening.ranked_top(kept, "CPI_technique", 10)


@query("value_percentile")
def _(spark, sf):
    return consensus.value_percentile(P.features(spark, sf), "cluster_score")


@query("minmax_profile")
def _(spark, sf):
    df = P.features(spark, sf).withColumn("svf_mean", F.lit(0.25))
    return scoring.minmax_columns(df, K.FEATURES).select("parcel_id", *K.FEATURES)


# --- screening -----------------------------------------------------------------------------------------------
@query("screen_parcels")
def _(spark, sf):
    return screening.screen_parcels(P.scored(spark, sf)).select("parcel_id", "CPI_technique", "consensus_confidence", "slope_p90", "surface_m2", "cat")


@query("screen_profiles")
def _(spark, sf):
    return screening.screen_profiles(P.scored(spark, sf))


@query("screen_kpis")
def _(spark, sf):
    return screening.screen_kpis(P.scored(spark, sf), shap(spark, sf))


@query("shortlist")
def _(spark, sf):
    wanted = S.table(spark, sf, "part").selectExpr(
        "case p_partkey%4 when 0 then concat(' 7306-5 ab ', cast(p_partkey as string)) when 1 then concat('73065AB', cast(p_partkey as string)) "
        "when 2 then concat('73065AB', cast(p_partkey-1 as string)) else concat('99999ZZ', cast(p_partkey as string)) end requested"
    )
    df = P.scored(spark, sf).withColumn("ref", F.concat(F.lit("73065AB"), F.col("parcel_id").cast("string")))
    return screening.shortlist(df, wanted, ref="ref").select("parcel_id", "CPI_technique", "consensus_confidence", "slope_p90", "surface_m2")


@query("verdict")
def _(spark, sf):
    v = screening.business_verdict(P.scored(spark, sf))
    return v.select("parcel_id", "verdict", "summary", *[F.array_join(c, " | ").alias(c) for c in ("strengths", "risks", "actions")], "confidence_txt")


@query("shap_top_factors")
def _(spark, sf):
    t = screening.shap_top_factors(shap(spark, sf))
    return t.select("parcel_id", F.array_join("top_positive", ",").alias("top_positive"), F.array_join("top_negative", ",").alias("top_negative"))


@query("alerts")
def _(spark, sf):
    return screening.alerts(P.scored(spark, sf)).select("parcel_id", F.array_join("alerts", " | ").alias("alerts"))


# --- incremental recomputation -----------------------------------------------------------------------------
@query("incremental_refresh")
def _(spark, sf):
    # of two columns one is null; in a third of the changed parcels only their places are swapped
    now = S.table(spark, sf, "lineitem").selectExpr("l_partkey as parcel_id", "l_quantity as q", "cast(null as double) as r")
    before = now.where("parcel_id%11<>0").withColumns({
        "q": F.expr("case when parcel_id%15=0 then null when parcel_id%5=0 then q+1 else q end"), "r": F.expr("case when parcel_id%15=0 then q end")})
    total = lambda d: d.groupBy("parcel_id").agg(F.sum(F.coalesce("q", "r")).alias("total_q"))
    marks = P.fingerprint(before, "parcel_id", ["q", "r"]).withColumn("input_hash", F.xxhash64("input_hash", F.lit("")))
    stored = materialise(total(before).join(marks, "parcel_id"), "stored")
    return P.incremental_refresh(now, ["q", "r"], stored, total).select("parcel_id", "total_q", "reused")


@query("family_refresh")
def _(spark, sf):
    base = S.parcels(spark, sf).select("parcel_id")
    shape = S.parcel_shape(spark, sf).select("parcel_id", "compactness_ratio", "elongation_ratio")
    flags = lambda: spatial.hazard_flags(S.parcels(spark, sf), S.hazard_points(spark, sf), S.HAZARD_LAYERS, S.GRID)
    old = {"parcels": P.table_fingerprint(S.parcels(spark, sf)), "hazards": 0}
    new = {"parcels": P.table_fingerprint(S.parcels(spark, sf)), "hazards": P.table_fingerprint(S.hazard_points(spark, sf))}
    stale = P.stale_families(old, new)
    stored = {"parcel_shape": materialise(shape, "family-shape"),
              "zoning_context": base.withColumns({f"brgm_{l}_flag": F.lit(None).cast("boolean") for l in S.HAZARD_LAYERS})}
    return P.family_refresh(stored, stale, {"parcel_shape": lambda: shape, "zoning_context": flags}, base)


__all__ = ["QUERIES", "rounded"]
