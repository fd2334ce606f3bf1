import gzip
import json

from pyspark.sql import functions as F

from lotwise.functions import geometry as G
from lotwise.operators import cleaning
from lotwise.plans import stages as P
from lotwise.sources import readers, sinks


def test_csv_dialects(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,lon,lat\n1,5.5,45.5\n2,bad,45\n")
    (tmp_path / "b.csv").write_text('some title, with commas\nmade on, 2024\n\nnom;latitude;longitude\n"x;y";46.5;6.5\n')
    (tmp_path / "c.csv").write_text("id,nothing\n1,2\n")
    got = {(r.lon, r.lat) for r in readers.scan_csv_dialect(spark, f"{tmp_path}/*.csv").collect()}
    assert got == {(5.5, 45.5), (6.5, 46.5)}


def test_gz_commune_fallback(spark, tmp_path):
    path = str(tmp_path / "s.csv.gz")
    with gzip.open(path, "wt") as f:
        f.write("id_parcelle,valeur_fonciere,surface_terrain,nature_mutation,code_commune\na,1,2,Vente,73065\nb,1,2,Vente,1\n")
    assert readers.scan_csv_gz(spark, path, readers.SALES_SCHEMA).count() == 1
    assert readers.scan_csv_gz(spark, path, readers.SALES_SCHEMA, "99999").count() == 2


def test_geojson_collection_and_multipolygon(spark, tmp_path):
    sq = lambda x: [[x, 0], [x + 2, 0], [x + 2, 2], [x, 2], [x, 0]]
    doc = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "id": "p1", "properties": {"typezone": "U"}, "geometry": {"type": "Polygon", "coordinates": [sq(0)]}},
        {"type": "Feature", "properties": {"id": "p2"}, "geometry": {"type": "MultiPolygon", "coordinates": [[sq(5)], [sq(9)]]}},
        {"type": "Feature", "id": "l1", "properties": {}, "geometry": {"type": "LineString", "coordinates": [[0, 0], [1, 1], [2, 1]]}}]}
    path = str(tmp_path / "x.json")
    with open(path, "w") as f:
        json.dump(doc, f)
    got = readers.scan_geojson(spark, path).where("ring is not null").select("id", G.area(F.col("ring")).alias("a")).collect()
    assert sorted((r.id, r.a) for r in got) == [("p1", 4.0), ("p2", 4.0), ("p2", 4.0)]
    assert readers.scan_lines_geojson(spark, path).count() == 2


def test_csv_keeps_empty_and_null_apart(spark, tmp_path):
    df = spark.createDataFrame([(1, ""), (2, None), (3, "x")], "k int, s string")
    sinks.sink_csv(df, str(tmp_path / "o"))
    back = {r.k: r.s for r in sinks.read_back_csv(spark, str(tmp_path / "o"), "k int, s string").collect()}
    assert back == {1: "", 2: None, 3: "x"}


def test_column_names_by_fragments():
    got = readers.resolve_columns(["Valeur Fonciere", "Surface reelle bati", "SURFACE_TERRAIN", "code_parcelle", "id_parcelle", "Nature mutation"])
    assert got == {"valeur_fonciere": "Valeur Fonciere", "surface_terrain": "SURFACE_TERRAIN", "id_parcelle": "code_parcelle", "nature_mutation": "Nature mutation"}


def test_price_rule_without_any_surface(spark):
    df = spark.createDataFrame([(5.0, None), (0.0, None)], "valeur_fonciere double, surface_terrain double")
    assert [r.prix_m2 for r in cleaning.price_per_m2(df).collect()] == [None]


def test_all_null_feature_is_filled_with_the_default(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), (None, None)], "a double, b double")
    assert [tuple(r) for r in cleaning.median_impute(df, ["a", "b"], 0.5).collect()] == [(0.5, 1.0), (0.5, 3.0), (0.5, 2.0)]


def test_refresh_follows_inputs_and_options(spark):
    now = spark.createDataFrame([(1, 1.0), (1, 2.0), (2, 5.0), (3, 7.0)], "parcel_id int, q double")
    total = lambda d: d.groupBy("parcel_id").agg(F.sum("q").alias("t"))
    old = now.where("parcel_id<3").withColumn("q", F.when(F.col("parcel_id") == 2, 4.0).otherwise(F.col("q"))).unionByName(
        spark.createDataFrame([(9, 1.0)], "parcel_id int, q double"))
    marks = P.fingerprint(old, "parcel_id", ["q"]).withColumn("input_hash", F.xxhash64("input_hash", F.lit("")))
    stored = total(old).join(marks, "parcel_id")
    got = {r.parcel_id: (r.t, r.reused) for r in P.incremental_refresh(now, ["q"], stored, total).collect()}
    assert got == {1: (3.0, True), 2: (5.0, False), 3: (7.0, False)}
    assert not any(r.reused for r in P.incremental_refresh(now, ["q"], stored, total, options="x").collect())


def test_a_null_counts_by_its_place(spark):
    one, two = (spark.createDataFrame([(1, *r)], "parcel_id int, a int, b int") for r in ((None, 5), (5, None)))
    assert P.fingerprint(one, "parcel_id", ["a", "b"]).first() != P.fingerprint(two, "parcel_id", ["a", "b"]).first()
    assert P.table_fingerprint(one) != P.table_fingerprint(two)


def test_family_staleness():
    assert P.stale_families({"parcels": 1, "buildings": 2}, {"parcels": 1, "buildings": 3}) == ["ces_residual"]
    assert "svf" in P.stale_families({}, {"height": 1})


def test_the_whole_batch(spark, sf, tmp_path):
    out = str(tmp_path)
    df = P.run_batch(spark, sf, out, n_estimators=2, runs=2, restarts=1, maxIter=2)
    counts = df.selectExpr("count(*) n", "count_if(is_valid) v", "count(CPI_ML_v3) m", "count(cpi_ml_std) s", "count(cluster_score) c", "min(n_approaches_used) a").first()
    assert counts.n == 1500 and counts.m == counts.s == counts.c == counts.v and counts.a >= 1
    report = spark.read.json(f"{out}/report").first()
    assert report.n_labeled == report.n_pos + report.n_neg and report.n_valid == counts.v
    assert spark.read.option("header", True).csv(f"{out}/learning_set").count() == report.n_labeled
    assert spark.read.option("header", True).csv(f"{out}/contributions").count() == report.n_labeled


def test_a_cleared_stage_is_written_again(spark, sf):
    build = lambda: spark.range(3)
    first = P.stage(spark, sf, "probe", build)
    assert first.count() == 3
    slot = (spark.sparkContext.applicationId, sf, "probe")
    P._staged[slot] = (first, P._staged[slot][1] + "-gone")
    assert P.stage(spark, sf, "probe", build).count() == 3
