"""The study area: every input table of the pipeline, derived from the star-schema tables.

Geometries are axis-aligned rectangles, so their joins have closed forms.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.functions import geometry as G
from lotwise.operators.order_stats import grouped_quantiles

GRID = 300.0  # spatial join cell, about the size of a zone
HAZARD_LAYERS = ["argiles", "mvt_terrain"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parcels(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey as parcel_id",
        "cast(925000+(o_orderkey*7919)%4000 as double) xmin",
        "cast(6499000+(o_orderkey*104729)%6000 as double) ymin",
        "cast(925005+(o_orderkey*7919)%4000+(o_orderkey*31)%80 as double) xmax",
        "cast(6499005+(o_orderkey*104729)%6000+(o_orderkey*17)%80 as double) ymax",
    )


def buildings(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(
        "c_custkey as building_id",
        "cast(925000+(c_custkey*6007)%4000 as double) xmin",
        "cast(6499000+(c_custkey*90001)%6000 as double) ymin",
        "cast(925004+(c_custkey*6007)%4000+(c_custkey*13)%30 as double) xmax",
        "cast(6499004+(c_custkey*90001)%6000+(c_custkey*11)%30 as double) ymax",
    )


def zones(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey as zone_id",
        "cast(925000+(s_suppkey*1301)%4000 as double) xmin",
        "cast(6499000+(s_suppkey*2903)%6000 as double) ymin",
        "cast(925600+(s_suppkey*1301)%4000 as double) xmax",
        "cast(6499900+(s_suppkey*2903)%6000 as double) ymax",
        "case s_nationkey%7 when 0 then 'U' when 1 then ' ub ' when 2 then 'AU' when 3 then 'Nh' "
        "when 4 then 'A' when 5 then 'UA' else null end typezone",
    )


def hazard_points(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey as hazard_id",
        "cast(925000+(p_partkey*3571)%4000 as double)+0.5D x",
        "cast(6499000+(p_partkey*7187)%6000 as double)+0.5D y",
        "case when p_partkey%3=0 then 'argiles' else 'mvt_terrain' end layer",
    )


def roads(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "nation").selectExpr(
        "n_nationkey as road_id",
        "925000.0D x1",
        "cast(6499000+n_nationkey*240 as double) y1",
        "929000.0D x2",
        "cast(6499000+(n_nationkey*997)%6000 as double) y2",
    )


def cells(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey div 50 as r", "o_orderkey%50 as c", "o_orderkey as k"
    ).selectExpr(
        "r", "c", "case when k%211=0 then null else cast((r*r*3+c*c*5+r*c)%997 as double)/10.0D end z"
    )


def sales(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(
        "cast(l_partkey as string) id_parcelle",
        "l_extendedprice valeur_fonciere",
        "case when l_linenumber=7 then 0.0D else l_quantity end surface_terrain",
        "case when l_returnflag='R' then 'Echange' when l_returnflag='A' then 'Vente' "
        "else 'Vente en l''etat futur d''achevement' end nature_mutation",
        "case when l_suppkey%3=0 then '73065' else '73008' end code_commune",
    )


SURFACE = "cast(10+(parcel_id*37)%6000 as double) surface_m2"
ZONE = (
    "case parcel_id%7 when 0 then 'U' when 1 then 'UA' when 2 then 'UB' when 3 then 'AU' "
    "when 4 then 'N' when 5 then 'A' else 'inconnu' end zone_plu"
)


def land_register(spark, sf_dir) -> DataFrame:
    """Every parcel with its registered surface and zone."""
    return parcels(spark, sf_dir).selectExpr("parcel_id", SURFACE, ZONE)


def terrain_features(spark, sf_dir) -> DataFrame:
    """Zonal features per parcel: ``lineitem`` rows are the cells, ``l_partkey`` is the zone."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"
    )
    cell_rows = li.withColumn("slope", F.expr("l_quantity*(0.1D+0.08D*(l_partkey%10))"))
    stats = grouped_quantiles(
        cell_rows.withColumnRenamed("l_partkey", "parcel_id"),
        ["parcel_id"],
        [(F.col("slope"), {"slope_p50": 0.5, "slope_p90": 0.9})],
        [
            F.stddev_pop("slope").alias("slope_std"),
            F.avg("l_extendedprice").alias("_price"),
            F.avg(F.expr("case when l_discount>0.07D then 1.0D else 0.0D end")).alias("_wet"),
            F.avg("l_tax").alias("_tax"),
            F.avg("slope").alias("_slope"),
            F.avg("l_discount").alias("_disc"),
            F.avg(F.expr("case when l_linenumber<=3 then 1.0D else 0.0D end")).alias("aspect_south_ratio_mean"),
        ],
    )
    return stats.selectExpr(
        "parcel_id", "slope_p50", "slope_p90", "slope_std",
        "case when parcel_id%11=0 then null else _price/10000 end twi_mean",
        "_wet*(parcel_id%4)/3 has_thalweg_mean",
        "_tax-0.04D profile_curvature_mean",
        "_slope/20 tri_mean",
        "_disc*8 hillshade_winter_mean",
        "aspect_south_ratio_mean",
        "case when parcel_id%7=0 then null else _tax*10 end svf_mean",
        SURFACE, ZONE,
        "case when parcel_id%13=0 then null else cast((parcel_id*29)%101 as double) end cluster_score",
    )


def market_scores(spark, sf_dir) -> DataFrame:
    """External approach 3: ids written with blanks, dashes and lower case; two thirds of the parcels."""
    return table(spark, sf_dir, "part").where("p_partkey%3<>1").selectExpr(
        "concat(' 73065-', lower('AB'), ' ', cast(p_partkey as string)) id_parcelle",
        "cast((p_partkey*17)%101 as double) CPI_market",
    )


def preference_scores(spark, sf_dir) -> DataFrame:
    """External approach 4: half of the parcels, already normalised ids, some null scores."""
    return table(spark, sf_dir, "part").where("p_partkey%2=0").selectExpr(
        "concat('73065AB', cast(p_partkey as string)) id_parcelle_norm",
        "case when p_partkey%10=4 then null else cast((p_partkey*23)%97 as double) end CPI_preference",
    )


def model_scores(spark, sf_dir) -> DataFrame:
    """Outputs a fitted ranker and its bootstrap would leave, as plain columns of ``part``."""
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey as parcel_id",
        "case when p_partkey%17=0 then null else cast((p_partkey*53)%1001 as double)/10.0D end CPI_ML_v3",
        "cast((p_partkey*7)%90 as double)/10.0D cpi_ml_std",
    ).selectExpr(
        "*", "CPI_ML_v3-2.0D*cpi_ml_std as cpi_ml_ci_low", "CPI_ML_v3+2.0D*cpi_ml_std as cpi_ml_ci_high"
    )


def parcel_shape(spark, sf_dir) -> DataFrame:
    """Shape ratios, area and 300 m block of every parcel, from its ring; parcels with equal rings are measured once."""
    box = ["xmin", "ymin", "xmax", "ymax"]
    p = parcels(spark, sf_dir)
    rings = p.select(*box).distinct().withColumn("ring", G.rect_ring(*box))
    measured = shape_of(rings).select(*box, "area_m2", "compactness_ratio", "elongation_ratio", "block_id")
    return p.join(measured.hint("merge"), box, "left").drop(*box)


def shape_of(p: DataFrame) -> DataFrame:
    p = p.withColumn("_m", G.measures(F.col("ring"))).withColumn("_b", G.bounds(F.col("ring")))
    m, b = F.col("_m"), F.col("_b")
    return p.withColumns(
        {
            "area_m2": m["area"],
            "perimeter_m": m["perimeter"],
            "cx": m["cx"],
            "cy": m["cy"],
            "compactness_ratio": G.compactness(m["area"], m["perimeter"]),
            "elongation_ratio": G.elongation(b["xmin"], b["ymin"], b["xmax"], b["ymax"]),
            "block_id": G.block_id(m["cx"], m["cy"], GRID),
        }
    ).drop("_m", "_b")
