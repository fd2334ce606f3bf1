"""Tables that grow with the input are shuffled, however small the estimate by file size."""

from lotwise.operators import consensus, joins, zonal


def physical(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def stored(df, path):
    df.write.parquet(str(path))
    return df.sparkSession.read.parquet(str(path))


def test_zones_spread_over_buckets_are_not_broadcast(spark, tmp_path):
    zones = stored(spark.range(50).selectExpr("id as zone_id", "id*1.0D xmin", "0.0D ymin", "id+2.0D xmax", "3.0D ymax"), tmp_path / "z")
    cells = stored(spark.range(100).selectExpr("id as r", "id%10 as c", "id*0.5D x", "id%10*1.0D y", "id*1.0D z"), tmp_path / "c")
    near = zonal.cells_within(cells, zones, 20.0, "zone_id")
    found = [line for line in physical(near).splitlines() if "_part" in line and "Join" in line]
    assert found and all("SortMergeJoin" in line for line in found)
    stats = physical(zonal.zonal_stats(zones, near, "z", "z", ["max"], "zone_id"))
    assert "SortMergeJoin [zone_id" in stats


def test_scores_and_families_are_not_broadcast(spark, tmp_path):
    ids = stored(spark.range(20).selectExpr("id as parcel_id", "concat('A', id) ref", "id*1.0D v"), tmp_path / "i")
    scores = stored(spark.range(20).selectExpr("concat('a', id) name", "id*1.0D s"), tmp_path / "s")
    for df in (consensus.external_score(ids, scores, "name", "s", "ref"), joins.attach_features(ids, [ids.selectExpr("parcel_id", "v as w")]),
               joins.align_scores(ids, ids.selectExpr("parcel_id", "v as w"), "w"), joins.semi_join_ids(ids, ids)):
        assert "Broadcast" not in physical(df) and "SortMergeJoin" in physical(df)
        assert df.count() == 20
