"""Readers of detections, facilities, roads, saved results and GeoJSON."""

from __future__ import annotations

import csv
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberflow.config import Area
from emberflow.functions.geo import tile_code
from emberflow.operators.ingest import check_header, inferred_instrument

# The tags that tell a facility's kind, in order.
KIND_TAGS = ("power", "industrial", "landuse", "man_made")


def headers(spark: SparkSession, paths: str | list[str]) -> list[tuple[tuple[str, ...], list[str]]]:
    """The headers of CSV files, each with the files that have it; only the first line of each file is kept."""
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").text(paths)
    begun = lines.where(F.col("_metadata.file_block_start") == 0)
    first = begun.select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("n"), "value").groupBy("file").agg(F.min_by("value", "n").alias("header"))
    by_header = first.groupBy("header").agg(F.sort_array(F.collect_list("file")).alias("files")).orderBy("header")
    return [(tuple(next(csv.reader([r.header.lstrip("\ufeff")]), [])), r.files) for r in by_header.collect()]  # a row for each header


def detection_files(spark: SparkSession, paths: str | list[str], required: bool = True) -> DataFrame:
    """All columns of CSV files as text, with source_file. Files are read by the names in their own headers, whatever the
    order; columns that a file lacks are null, but the instrument, which follows from the bands that the file has. A file
    without a required column is an error."""
    out = None
    for header, files in headers(spark, paths):
        schema = T.StructType([T.StructField(c.strip(), T.StringType()) for c in header])
        df = spark.read.schema(schema).option("header", True).option("enforceSchema", True).csv([unquote(f) for f in files])
        df = df.withColumn("source_file", F.col("_metadata.file_path"))
        if required:
            try:
                check_header(df.columns)
            except ValueError as e:
                raise ValueError(f"{files[0]}: {e}") from None
            if "instrument" not in df.columns:
                df = df.withColumn("instrument", F.lit(inferred_instrument(df.columns)))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise ValueError(f"there are no CSV files in {paths}")
    return out


def sidecars(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(stem, source_url, source_retrieved_at, sidecar_quality) of ``.meta.json`` files."""
    schema = "url string, retrieved_at string, data_quality string"
    df = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.meta.json").json(paths)
    stem = F.regexp_replace(F.col("_metadata.file_path"), r"\.meta\.json$", "")
    return df.select(stem.alias("stem"), F.col("url").alias("source_url"), F.col("retrieved_at").alias("source_retrieved_at"), F.col("data_quality").alias("sidecar_quality"))


def with_sidecars(rows: DataFrame, side: DataFrame) -> DataFrame:
    """Rows with their file's sidecar; files without one have nulls."""
    stem = F.regexp_replace("source_file", r"\.csv$", "")
    return rows.withColumn("stem", stem).join(side, "stem", "left").drop("stem")


POINT = T.ArrayType(T.StructType([T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType())]))
ELEMENT = T.StructType([T.StructField("type", T.StringType()), T.StructField("id", T.LongType()), T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType()), T.StructField("tags", T.MapType(T.StringType(), T.StringType())), T.StructField("geometry", POINT), T.StructField("members", T.ArrayType(T.StructType([T.StructField("geometry", POINT)])))])


def map_elements(spark: SparkSession, path: str) -> DataFrame:
    """Elements of a map extract in JSON, a row each."""
    return spark.read.schema(T.StructType([T.StructField("elements", T.ArrayType(ELEMENT))])).option("multiLine", True).json(path).select(F.inline("elements"))


def facilities(elements: DataFrame) -> DataFrame:
    """Facilities of map elements: their parts (own line, members' lines, or the point), kind by the first known tag, mean position."""
    own = F.when(F.size("geometry") > 0, F.array("geometry")).otherwise(F.array().cast(T.ArrayType(POINT)))
    members = F.filter(F.transform(F.coalesce("members", F.array().cast(ELEMENT["members"].dataType)), lambda m: m["geometry"]), lambda g: F.size(g) > 0)
    point = F.when(F.col("lat").isNotNull(), F.array(F.array(F.struct("lat", "lon")))).otherwise(F.array().cast(T.ArrayType(POINT)))
    lines = F.concat(own, members)
    parts = F.when(F.size(lines) > 0, lines).otherwise(point)
    kind = F.coalesce(*(F.concat(F.lit(f"{t}="), F.col("tags")[t]) for t in KIND_TAGS), F.lit("industrial_context"))
    flat = F.flatten("parts")
    mean = lambda c: F.aggregate(flat, F.lit(0.0), lambda s, p: s + p[c]) / F.size(flat)
    out = elements.select(F.concat_ws(":", F.lit("osm"), "type", F.col("id").cast("string")).alias("facility_id"), F.coalesce(F.col("tags")["name"], F.col("tags")["operator"], F.lit("Unnamed mapped feature")).alias("name"), kind.alias("kind"), parts.alias("parts"), F.col("id").alias("fac_ord"))
    return out.where(F.size("parts") > 0).withColumns({"latitude": mean("lat"), "longitude": mean("lon")})


def roads(elements: DataFrame) -> DataFrame:
    """(osm_id, coordinates): lines of two points or more."""
    line = F.transform("geometry", lambda p: F.array(p["lon"], p["lat"]))
    return elements.where(F.size("geometry") >= 2).select(F.col("id").alias("osm_id"), line.alias("coordinates"))


def geojson(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """Point features as rows: their properties (a schema) with longitude and latitude."""
    schema = f"features array<struct<geometry: struct<type: string, coordinates: array<double>>, properties: struct<{properties}>>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select(F.inline("features"))
    return rows.select("properties.*", F.get("geometry.coordinates", F.lit(0)).alias("longitude"), F.get("geometry.coordinates", F.lit(1)).alias("latitude"))


def optional(spark: SparkSession, path: str, schema: str, kind: str = "json") -> tuple[DataFrame, str]:
    """(rows, status): cached, empty_cache, not_cached or unreadable_cache; rows are empty where there are none."""
    try:
        df = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").format(kind).load(path)
        status = "empty_cache" if df.isEmpty() else "cached"
        return df, status
    except AnalysisException:
        return spark.createDataFrame([], schema), "not_cached"
    except Exception:  # a file that can't be parsed
        return spark.createDataFrame([], schema), "unreadable_cache"


def optional_geojson(spark: SparkSession, path: str, properties: str) -> tuple[DataFrame, str]:
    """(rows of ``geojson``, status): cached, empty_cache, not_cached, unreadable_cache, or invalid_cache where the document
    is no FeatureCollection."""
    schema = "type string, features array<string>"
    none = spark.createDataFrame([], f"{properties.replace(':', ' ')}, longitude double, latitude double")
    doc, status = optional(spark, path, schema)
    if status == "cached":
        whole = doc.agg(F.count_if((F.col("type") == "FeatureCollection") & F.col("features").isNotNull()).alias("good"), F.count("*").alias("n"), F.sum(F.coalesce(F.size("features"), F.lit(0))).alias("rows")).first()
        status = "invalid_cache" if whole.good != whole.n else "cached" if whole.rows else "empty_cache"
    return (geojson(spark, path, properties), status) if status == "cached" else (none, status)


def results(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A saved result: Parquet, which has its types, or with a schema the CSV that ``sinks.csv`` writes. Times are read as
    times and numbers as they were written; a value that isn't of its type is an error. A schema of strings gives rows as they stand."""
    if schema is None:
        return spark.read.parquet(path)
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").csv(path)


def download_plan(spark: SparkSession, years: list[int], products: list[str]) -> DataFrame:
    """Each year with each product."""
    return spark.createDataFrame([(y,) for y in years], "year int").crossJoin(spark.createDataFrame([(p,) for p in products], "product string"))


def recoverable(content: Column, etag: Column) -> Column:
    """Whether a partial download is whole: its MD5 is the strong entity tag that was kept. Weak and other tags tell nothing."""
    strong = F.regexp_extract(F.coalesce(etag, F.lit("")), '^"([0-9a-fA-F]{32})"$', 1)
    return F.coalesce((strong != "") & (F.md5(content) == F.lower(strong)), F.lit(False))


def may_follow(link: Column, first: Column) -> Column:
    """Whether the next page's link stays with the scheme and host (and port) of the first request."""
    origin = lambda c: F.lower(F.regexp_extract(F.coalesce(c, F.lit("")), r"^(https?://[^/?#@\\\s]+)(?:[/?#]|$)", 1))
    return (origin(link) != "") & (origin(link) == origin(first))


def area_tiles(spark: SparkSession, area: Area, step: int = 3) -> DataFrame:
    """(tile): the names of the raster tiles that an area touches."""
    corner = lambda lo, hi: F.explode(F.sequence(F.floor(F.lit(lo) / step) * step, F.floor(F.lit(hi) / step) * step, F.lit(step).cast("bigint")))
    cells = spark.range(1).select(corner(area.south, area.north).alias("lat")).select("lat", corner(area.west, area.east).alias("lon"))
    return cells.select(tile_code(F.col("lat"), F.col("lon"), step).alias("tile"))


def preflight(spark: SparkSession, paths: str | list[str], mapped: DataFrame, pixels: DataFrame, area: Area) -> DataFrame:
    """(check, subject): what stands in the way of a run. CSV files without a required column, no usable facility, tiles of the
    area without a pixel. Nothing is written; only headers are read of the CSV files."""
    found = []
    known = headers(spark, paths)
    if not known:
        found.append(("no_detection_files", ""))
    for header, files in known:
        try:
            check_header([c.strip() for c in header])
        except ValueError:
            found += [("invalid_header", f) for f in files]
    if mapped.isEmpty():
        found.append(("no_facilities", ""))
    missing = area_tiles(spark, area).join(pixels.select("tile").distinct(), "tile", "left_anti").select(F.lit("missing_tile").alias("check"), F.col("tile").alias("subject"))
    return spark.createDataFrame(found, "check string, subject string").unionByName(missing)
