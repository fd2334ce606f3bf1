"""Readers of the input files. All name their schema; none infers types from data."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise import catalog as K
from lotwise.functions import geometry as G

SALES_SCHEMA = "id_parcelle string, valeur_fonciere string, surface_terrain string, nature_mutation string, code_commune string"


def scan_csv(spark: SparkSession, path: str, schema: str, sep: str = ",") -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("sep", sep).csv(path)


def scan_csv_gz(spark: SparkSession, path: str, schema: str, code: str = K.COMMUNE_CODE, column: str = "code_commune") -> DataFrame:
    """Rows of one commune, or all rows when it has none. A gz file is one task to read, so rows are spread
    at once."""
    df = scan_csv(spark, path, schema)
    df = df.repartition(spark.sparkContext.defaultParallelism)
    match = df.where(F.trim(column) == code)
    return df if match.isEmpty() else match


def _pieces(line: Column, sep: str) -> Column:
    """Fields of a line; a separator inside quotes does not split."""
    parts = F.split(line, sep + r'(?=(?:[^"]*"[^"]*")*[^"]*$)')
    return F.transform(parts, lambda p: F.btrim(F.btrim(p), F.lit('"')))


def _first_position(names: Column, candidates: Sequence[str]) -> Column:
    """1-based place of the first candidate that the header has."""
    at = [F.when(F.array_contains(names, c), F.array_position(names, c)) for c in candidates]
    return F.coalesce(*at)


def scan_csv_dialect(spark: SparkSession, path: str, lon: Sequence[str] = tuple(K.LON_COLUMNS), lat: Sequence[str] = tuple(K.LAT_COLUMNS)) -> DataFrame:
    """Points (``lon``, ``lat``, ``source``) of CSV files in mixed dialects: comma or semicolon, with or
    without lines before the header.

    The header of a file is its line that names a longitude and a latitude column under one separator, so
    files stay splittable and each may have its own dialect.
    """
    lines = spark.read.text(path).select(F.col("value"), F.col("_metadata.file_path").alias("source"))
    found = []
    for sep in (",", ";"):
        names = _pieces(F.col("value"), sep)
        spot = lines.where(F.col("value").contains(sep)).select(
            "source", F.lit(sep).alias("sep"), _first_position(names, lon).alias("ilon"), _first_position(names, lat).alias("ilat")
        )
        found.append(spot.where(F.col("ilon").isNotNull() & F.col("ilat").isNotNull()))
    headers = reduce(DataFrame.unionByName, found).groupBy("source").agg(
        F.min(F.struct("sep", "ilon", "ilat")).alias("h")
    )
    fields = F.when(F.col("h.sep") == ",", _pieces(F.col("value"), ",")).otherwise(_pieces(F.col("value"), ";"))
    pick = lambda i: F.get(fields, F.col(i).cast("int") - 1).try_cast("double")
    points = lines.join(headers, "source").select("source", pick("h.ilon").alias("lon"), pick("h.ilat").alias("lat"))
    return points.where(F.col("lon").isNotNull() & F.col("lat").isNotNull())


def scan_points(df: DataFrame, lon: Sequence[str] = tuple(K.LON_COLUMNS), lat: Sequence[str] = tuple(K.LAT_COLUMNS)) -> DataFrame:
    """First present longitude and latitude columns, projected to metres as ``x`` and ``y``."""
    pick = lambda names: next((n for n in names if n in df.columns), None)
    a, b = pick(lon), pick(lat)
    if not a or not b:
        raise ValueError(f"no longitude/latitude column among {df.columns}")
    xy = G.to_lambert93(F.col(a).try_cast("double"), F.col(b).try_cast("double"))
    others = [c for c in df.columns if c not in (a, b)]
    return df.select(*others, xy.alias("_p")).select(*others, F.col("_p.x").alias("x"), F.col("_p.y").alias("y"))


_FEATURE = "struct<id:string, properties:map<string,string>, geometry:struct<type:string, coordinates:string>>"


def _parts(df: DataFrame) -> DataFrame:
    """One row per polygon part: exterior ring of a Polygon, of each member of a MultiPolygon."""
    g = F.col("f.geometry")
    one = F.array(F.from_json(g["coordinates"], "array<array<array<double>>>"))
    many = F.from_json(g["coordinates"], "array<array<array<array<double>>>>")
    polygons = F.when(g["type"] == "Polygon", one).when(g["type"] == "MultiPolygon", many)
    ring = F.transform(F.get("polygon", F.lit(0)), lambda p: G.point(F.get(p, F.lit(0)), F.get(p, F.lit(1))))
    return (
        df.select(F.coalesce("f.id", F.element_at("f.properties", F.lit("id"))).alias("id"), F.col("f.properties").alias("properties"), F.explode_outer(polygons).alias("polygon"))
        .select("id", "properties", ring.alias("ring"))
    )


def scan_geojson(spark: SparkSession, path: str) -> DataFrame:
    """FeatureCollections, one row per polygon part. A collection is one document and one task: prefer
    ``scan_geojson_lines`` for large layers."""
    raw = spark.read.schema(f"features array<{_FEATURE}>").option("multiLine", True).json(path)
    return _parts(raw.select(F.explode("features").alias("f")))


def scan_geojson_lines(spark: SparkSession, path: str) -> DataFrame:
    """One feature per line, splittable."""
    raw = spark.read.schema("id string, properties map<string,string>, geometry struct<type:string, coordinates:string>").json(path)
    return _parts(raw.select(F.struct("id", "properties", "geometry").alias("f")))


def scan_lines_geojson(spark: SparkSession, path: str) -> DataFrame:
    """Line layers (roads), one row per segment: ``x1 y1 x2 y2``."""
    raw = spark.read.schema(f"features array<{_FEATURE}>").option("multiLine", True).json(path)
    g = F.col("f.geometry")
    one = F.array(F.from_json(g["coordinates"], "array<array<double>>"))
    many = F.from_json(g["coordinates"], "array<array<array<double>>>")
    lines = F.when(g["type"] == "LineString", one).when(g["type"] == "MultiLineString", many)
    n = F.size("line")
    steps = F.zip_with(F.slice("line", F.lit(1), n - 1), F.slice("line", F.lit(2), n - 1), lambda a, b: F.struct(
        F.get(a, F.lit(0)).alias("x1"), F.get(a, F.lit(1)).alias("y1"), F.get(b, F.lit(0)).alias("x2"), F.get(b, F.lit(1)).alias("y2")))
    return (
        raw.select(F.explode("features").alias("f")).select("f.id", F.explode(lines).alias("line")).where(n > 1)
        .select("id", F.inline(steps))
    )


def scan_raster_cells(spark: SparkSession, path: str, tiles: Sequence[str] | None = None) -> DataFrame:
    """Cell table partitioned by ``tile_id``; nodata to NULL; only the wanted tiles are read."""
    df = spark.read.parquet(path)
    if tiles is not None:
        df = df.where(F.col("tile_id").isin(*tiles))
    z = F.col("z").cast("double")
    return df.withColumn("z", F.when((z == K.NODATA) | F.isnan(z), None).otherwise(z))


def resolve_columns(columns: Sequence[str], fragments: Mapping[str, Sequence[Sequence[str]]] = K.SALE_COLUMN_FRAGMENTS) -> dict[str, str]:
    """Logical name to physical column: the first column whose lower-cased name holds all fragments of one
    of the alternatives. A column serves one logical name."""
    out: dict[str, str] = {}
    for column in columns:
        flat = column.lower().replace(" ", "_")
        for logical, alternatives in fragments.items():
            if any(all(f in flat for f in alt) for alt in alternatives):
                if logical not in out:
                    out[logical] = column
                    break
    return out


def first_present(columns: Sequence[str], candidates: Sequence[str]) -> str | None:
    return next((c for c in candidates if c in columns), None)


def unify_sources(sources: Sequence[DataFrame], fragments: Mapping[str, Sequence[Sequence[str]]] = K.SALE_COLUMN_FRAGMENTS) -> DataFrame:
    """Differently named tables under one set of logical names; a missing one is NULL."""
    parts = []
    for df in sources:
        found = resolve_columns(df.columns, fragments)
        commune = first_present(df.columns, K.COMMUNE_COLUMNS)
        cols = [F.col(p).cast("string").alias(l) for l, p in found.items()]
        if commune:
            cols.append(F.col(commune).cast("string").alias("code_commune"))
        parts.append(df.select(*cols))
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    wanted = [*fragments, "code_commune"]
    return merged.select(*[F.col(c) if c in merged.columns else F.lit(None).cast("string").alias(c) for c in wanted])
