"""From raw detection rows to clean, unique detections, with the counts of what was turned away.

Raw rows are text in every column. Columns that are missing are added as nulls, except the required ones.
All rules are column expressions, so area and time filters reach the scan, and one pass serves
detections as well as counts.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberflow.config import Area, Settings
from emberflow.functions import geo, text

REQUIRED = ("latitude", "longitude", "acq_date", "acq_time", "satellite")
OPTIONAL = ("instrument", "bright_ti4", "bright_ti5", "brightness", "bright_t31", "frp", "scan", "track", "confidence", "version", "daynight", "type", "source_file", "source_url", "source_retrieved_at", "sidecar_quality")
# Platform names by sensor, and confidence words.
SENSORS = {
    "VIIRS_SNPP": ("VIIRS", ("N", "SNPP", "SUOMINPP")),
    "VIIRS_NOAA20": ("VIIRS", ("N20", "NOAA20", "J1", "JPSS1")),
    "VIIRS_NOAA21": ("VIIRS", ("N21", "NOAA21", "J2", "JPSS2")),
    "MODIS_TERRA": ("MODIS", ("TERRA",)),
    "MODIS_AQUA": ("MODIS", ("AQUA",)),
}
CONFIDENCE = {"l": 0.2, "low": 0.2, "n": 0.6, "nominal": 0.6, "h": 1.0, "high": 1.0}
DEDUP_KEY = ("sensor", "latitude", "longitude", "acquired_at")


def check_header(columns: Iterable[str]) -> None:
    """Raises if a required column is missing."""
    missing = sorted(set(REQUIRED) - set(columns))
    if missing:
        raise ValueError(f"required columns are missing: {missing}")


def inferred_instrument(columns: Iterable[str]) -> str:
    """The instrument that the bands of a file without a column of that name tell."""
    have = set(columns)
    return "VIIRS" if {"bright_ti4", "bright_ti5"} <= have else "MODIS" if {"brightness", "bright_t31"} <= have else "UNSUPPORTED"


def with_optional(raw: DataFrame) -> DataFrame:
    """The raw rows with every optional column; the instrument follows from the bands that the file has."""
    check_header(raw.columns)
    inferred = inferred_instrument(raw.columns)
    new = {c: F.lit(inferred if c == "instrument" else None).cast("string") for c in OPTIONAL if c not in raw.columns}
    return raw.withColumns(new) if new else raw


def sensor(instrument: Column, satellite: Column) -> Column:
    """One of five sensors, or UNSUPPORTED."""
    kind = F.upper(instrument)
    name = F.regexp_replace(F.upper(satellite), "[^A-Z0-9]", "")
    out = F.lit("UNSUPPORTED")
    for s, (i, names) in SENSORS.items():
        out = F.when((kind == i) & name.isin(*names), s).otherwise(out)
    return out


def band(sensor_: Column, viirs: Column, modis: Column) -> Column:
    """The band that belongs to the sensor's instrument."""
    return F.when(sensor_.startswith("VIIRS"), text.number(viirs)).otherwise(text.number(modis))


def confidence_score(c: Column) -> Column:
    """0 to 1, from a word or from a number of 0 to 100; null otherwise."""
    word = F.lower(F.trim(c))
    out = F.least(F.greatest(text.number(c), F.lit(0.0)), F.lit(100.0)) / 100
    for w, score in CONFIDENCE.items():
        out = F.when(word == w, score).otherwise(out)
    return F.when(text.number(c).isNull() & ~word.isin(*CONFIDENCE), F.lit(None).cast("double")).otherwise(out)


def data_quality(version: Column, sidecar: Column) -> Column:
    return F.when(F.contains(F.upper(version), F.lit("NRT")), "near_real_time").when(text.number(version).isNotNull(), "science_quality").otherwise(F.coalesce(sidecar, F.lit("unknown")))


def judged(raw: DataFrame, settings: Settings, as_of: str) -> DataFrame:
    """Raw rows with typed columns and the flags coordinates_ok, time_ok, in_area, supported, accepted."""
    rows = with_optional(raw)
    lat, lon = text.number(F.col("latitude")), text.number(F.col("longitude"))
    at = text.acquired_at(F.col("acq_date"), F.col("acq_time"))
    typed = rows.withColumns({"latitude": lat, "longitude": lon, "acquired_at": at, "sensor": sensor(F.col("instrument"), F.col("satellite"))})
    limit = F.lit(as_of).cast("timestamp_ntz")
    flags = {
        "coordinates_ok": geo.valid_coordinates(F.col("latitude"), F.col("longitude")),
        "time_ok": F.coalesce(F.col("acquired_at") <= limit, F.lit(False)),
        "in_area": F.coalesce(geo.in_box(F.col("latitude"), F.col("longitude"), settings.area), F.lit(False)),
        "supported": F.col("sensor") != "UNSUPPORTED",
        "accepted": F.col("sensor").isin(*settings.accepted_sensors) if settings.accepted_sensors else F.col("sensor") != "UNSUPPORTED",
    }
    return typed.withColumns(flags)


def detections(judged_rows: DataFrame) -> DataFrame:
    """The valid rows of the area and of accepted sensors, with radiometry, confidence and provenance."""
    ok = judged_rows.where("coordinates_ok and time_ok and in_area and accepted and supported")
    s = F.col("sensor")
    radiance = ok.withColumns({"brightness": band(s, F.col("bright_ti4"), F.col("brightness")), "longwave_brightness": band(s, F.col("bright_ti5"), F.col("bright_t31"))})
    return radiance.select(
        "latitude", "longitude", "acquired_at", "sensor", "brightness", "longwave_brightness",
        (F.col("brightness") - F.col("longwave_brightness")).alias("brightness_temperature_difference"),
        *(text.positive(F.col(c)).alias(c) for c in ("frp", "scan", "track")),
        confidence_score(F.col("confidence")).alias("confidence_score"),
        text.number(F.col("type")).alias("firms_type_reference"),
        F.coalesce(F.col("daynight"), F.lit("unknown")).alias("daynight"),
        F.coalesce(F.col("version"), F.lit("unknown")).alias("source_version"),
        data_quality(F.coalesce(F.col("version"), F.lit("unknown")), F.col("sidecar_quality")).alias("data_quality"),
        "source_file", "source_url", "source_retrieved_at",
    )


def deduplicate(rows: DataFrame, order: list[Column] | None = None) -> DataFrame:
    """One row for each sensor, place and time: science quality before near real time, then the latest
    retrieval, then the last file and ``order``."""
    rank = F.when(F.col("data_quality") == "science_quality", 2).when(F.col("data_quality") == "near_real_time", 1).otherwise(0)
    by = [rank.desc(), F.col("source_retrieved_at").desc_nulls_last(), F.col("source_file").desc_nulls_last(), *(order or [])]
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*DEDUP_KEY).orderBy(*by))).where("_n = 1").drop("_n")


def detection_id(sensor_: Column, lat: Column, lon: Column, at: Column) -> Column:
    return text.short_id("D", F.concat_ws("|", sensor_, lat.cast("string"), lon.cast("string"), text.iso_utc(at)))


def ingest(raw: DataFrame, settings: Settings, as_of: str) -> DataFrame:
    """Clean, unique detections with their identifiers."""
    rows = deduplicate(detections(judged(raw, settings, as_of)))
    return rows.select(detection_id(*(F.col(c) for c in DEDUP_KEY)).alias("detection_id"), "*")


def file_audit(judged_rows: DataFrame) -> DataFrame:
    """The counters of each source file: rows are counted before the area filter, sensors inside it."""
    inside = F.col("coordinates_ok") & F.col("time_ok") & F.col("in_area")
    return judged_rows.groupBy("source_file").agg(
        F.count("*").alias("raw_rows"),
        F.count_if(~F.col("coordinates_ok")).alias("invalid_coordinate_rows"),
        F.count_if(~F.col("time_ok")).alias("invalid_or_future_time_rows"),
        F.count_if(inside & ~F.col("supported")).alias("unsupported_sensor_rows"),
        F.count_if(inside & F.col("supported") & ~F.col("accepted")).alias("excluded_sensor_rows"),
        F.count_if(inside & F.col("supported") & F.col("accepted")).alias("aoi_valid_rows"),
        F.min(F.when(F.col("time_ok"), F.col("acquired_at"))).alias("source_earliest"),
        F.max(F.when(F.col("time_ok"), F.col("acquired_at"))).alias("source_latest"),
    )


def year_sensor_quality(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.year("acquired_at").alias("year"), "sensor", "data_quality").agg(F.count("*").alias("detections"))


def missing_sensor_years(rows: DataFrame, years: tuple[int, ...], sensors: tuple[str, ...]) -> DataFrame:
    """Expected years and sensors without science-quality detections."""
    spark = rows.sparkSession
    expected = spark.createDataFrame([(y, s) for y in years for s in sensors], "year int, sensor string")
    present = rows.where("data_quality = 'science_quality'").select(F.year("acquired_at").alias("year"), "sensor").distinct()
    return expected.join(present, ["year", "sensor"], "left_anti")


def missing_years(rows: DataFrame, years: tuple[int, ...]) -> DataFrame:
    expected = rows.sparkSession.createDataFrame([(y,) for y in years], "year int")
    present = rows.where("data_quality = 'science_quality'").select(F.year("acquired_at").alias("year")).distinct()
    return expected.join(present, "year", "left_anti")


def union_files(parts: list[DataFrame]) -> DataFrame:
    """All rows of files whose columns may differ."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def area_filter(rows: DataFrame, area: Area) -> DataFrame:
    return rows.where(geo.in_box(F.col("latitude"), F.col("longitude"), area))
