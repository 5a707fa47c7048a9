"""Geographic context: nearest mapped facility, land cover around a point, and the label that follows from both."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberflow.config import Context
from emberflow.functions import geo
from emberflow.operators.clustering import checkpointed

#: Facilities are broadcast in blocks of at most so many vertices; more blocks are joined one after another.
BLOCK_VERTICES = 500_000
#: Points are taken together by cells of so many degrees to find the facilities that may be nearest.
CELL_DEGREES = 0.02
#: A ring's ends may lie so far apart.
RING_KM = 0.02
# Land-cover codes and their names.
LAND_COVER = {10: "tree_cover", 20: "shrubland", 30: "grassland", 40: "cropland", 50: "built_up", 60: "bare_sparse", 70: "snow_ice", 80: "water", 90: "herbaceous_wetland", 95: "mangroves", 100: "moss_lichen"}
VEGETATION_CODES = (10, 20, 30, 40, 90, 95, 100)


def segments(parts: Column) -> Column:
    """For each part an array of its segments (a1, o1, a2, o2, closing) and whether it is a ring; single points are one segment.

    A ring's ends may lie apart: the leg between them closes it, which counts for what is inside but has no distance.
    """

    def of(p: Column) -> Column:
        first, last, n = F.element_at(p, 1), F.element_at(p, -1), F.size(p)
        leg = lambda v, w, closing: F.struct(v["lat"].alias("a1"), v["lon"].alias("o1"), w["lat"].alias("a2"), w["lon"].alias("o2"), F.lit(closing).alias("closing"))
        legs = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: leg(F.element_at(p, i), F.element_at(p, F.least(i + 1, n)), False))
        gap = F.hypot((first["lon"] - last["lon"]) * geo.LON_KM * F.cos(F.radians(first["lat"])), (first["lat"] - last["lat"]) * geo.LAT_KM)
        ring = (n >= 4) & (gap < RING_KM)
        open_ = ring & ((first["lat"] != last["lat"]) | (first["lon"] != last["lon"]))
        return F.struct(F.when(open_, F.concat(legs, F.array(leg(last, first, True)))).otherwise(legs).alias("legs"), ring.alias("ring"))

    return F.transform(F.filter(parts, lambda p: F.size(p) > 0), of)


def _blocks(facilities: DataFrame) -> Iterator[DataFrame]:
    size = facilities.agg(F.sum(F.size(F.flatten("parts")))).first()[0] or 0
    n = max(1, -(-size // BLOCK_VERTICES))
    for k in range(n):
        yield facilities if n == 1 else facilities.where(F.pmod(F.hash("facility_id"), F.lit(n)) == k)


def nearest_facility(points: DataFrame, facilities: DataFrame, key: str = "event_id") -> DataFrame:
    """(key, facility_distance_km, nearest_facility_id, _name, _kind) of each point (``key``, latitude, longitude).

    Facilities have fac_ord, facility_id, name, kind and parts, lists of (lat, lon). Inside a ring the distance
    is 0, of equal ones the smallest fac_ord wins. Points without a position have no facility. Only occupied cells of
    ``CELL_DEGREES`` are compared with all facilities: a cell keeps those whose bounding box may be as near to one of its
    points as the nearest first vertex is to its farthest point. Places meet the facilities that their cell keeps.

    Facilities of equal parts are at equal distances, so only the first of them is compared; points at one place are measured
    once, and a place's legs stay in its row.
    """
    flat = F.flatten("parts")
    lat_of, lon_of = F.transform(flat, lambda v: v["lat"]), F.transform(flat, lambda v: v["lon"])
    first = F.min(F.struct("fac_ord", "facility_id", "name", "kind")).alias("f")
    boxed = facilities.where(F.size(flat) > 0).groupBy("parts").agg(first).select("f.*", "parts")
    boxed = boxed.withColumns({"south": F.array_min(lat_of), "north": F.array_max(lat_of), "west": F.array_min(lon_of), "east": F.array_max(lon_of), "v_lat": F.get(flat, F.lit(0))["lat"], "v_lon": F.get(flat, F.lit(0))["lon"]})
    boxed = checkpointed(boxed)
    cell = {"c_lat": F.floor(F.col("latitude") / CELL_DEGREES), "c_lon": F.floor(F.col("longitude") / CELL_DEGREES)}
    own = points.where("latitude is not null and longitude is not null").select("latitude", "longitude").distinct().withColumns(cell)
    own = checkpointed(own)
    cells = own.select("c_lat", "c_lon").distinct()
    margin = CELL_DEGREES * 1e-6
    low, high = F.col("c_lat") * CELL_DEGREES - margin, (F.col("c_lat") + 1) * CELL_DEGREES + margin
    left, right = F.col("c_lon") * CELL_DEGREES - margin, (F.col("c_lon") + 1) * CELL_DEGREES + margin
    scale_at = lambda lat: F.lit(geo.LON_KM) * F.cos(F.radians(F.least(lat, F.lit(90.0))))
    most = scale_at(F.when((low <= 0) & (high >= 0), 0.0).otherwise(F.least(F.abs(low), F.abs(high))))
    cells = cells.select("c_lat", "c_lon", low.alias("low"), high.alias("high"), left.alias("left"), right.alias("right"), most.alias("most"), scale_at(F.greatest(F.abs(low), F.abs(high))).alias("fewest"))
    best = None
    for block in _blocks(boxed):
        far_lat = F.greatest(F.abs(F.col("v_lat") - F.col("low")), F.abs(F.col("v_lat") - F.col("high")))
        far_lon = F.greatest(F.abs(F.col("v_lon") - F.col("left")), F.abs(F.col("v_lon") - F.col("right")))
        reach = F.min(F.hypot(far_lon * F.col("most"), far_lat * geo.LAT_KM)).alias("reach")
        reached = cells.join(F.broadcast(block.select("v_lat", "v_lon"))).groupBy(*cells.columns).agg(reach)
        gap_lat = F.greatest(F.col("south") - F.col("high"), F.col("low") - F.col("north"), F.lit(0.0))
        gap_lon = F.greatest(F.col("west") - F.col("right"), F.col("left") - F.col("east"), F.lit(0.0))
        near = F.hypot(gap_lon * F.col("fewest"), gap_lat * geo.LAT_KM) <= F.col("reach") + 1e-9
        ready = block.select("fac_ord", "facility_id", "name", "kind", "south", "north", "west", "east", "v_lat", "v_lon", segments(F.col("parts")).alias("parts"))
        kept = reached.join(F.broadcast(ready), near).groupBy("c_lat", "c_lon").agg(F.collect_list(F.struct(*ready.columns)).alias("some"))
        # each place once more: its own bound leaves few of its cell's facilities to be measured
        met = own.join(kept, ["c_lat", "c_lon"]).withColumn("reach", F.array_min(F.transform("some", _first_vertex)))
        measured = F.transform(F.filter("some", lambda f: _box(f) <= F.col("reach") + 1e-9), lambda f: F.struct(_measured(f["parts"]).alias("d"), f["fac_ord"].alias("fac_ord"), f["facility_id"].alias("facility_id"), f["name"].alias("name"), f["kind"].alias("kind")))
        top = met.select("latitude", "longitude", F.array_min(measured).alias("top"))
        best = top if best is None else best.unionByName(top).groupBy("latitude", "longitude").agg(F.min("top").alias("top"))
    out = points.select(F.col(key).alias("key"), "latitude", "longitude").join(best, ["latitude", "longitude"], "left")
    return out.select(F.col("key").alias(key), F.col("top.d").alias("facility_distance_km"), *(F.coalesce(f"top.{c}", F.lit("")).alias(f"nearest_facility_{n}") for c, n in (("facility_id", "id"), ("name", "name"), ("kind", "kind"))))


def _first_vertex(f: Column) -> Column:
    """The distance from the point to a facility's first vertex."""
    scale = geo.LON_KM * F.cos(F.radians("latitude"))
    return F.hypot((f["v_lon"] - F.col("longitude")) * scale, (f["v_lat"] - F.col("latitude")) * geo.LAT_KM)


def _box(f: Column) -> Column:
    """The distance from the point to a facility's bounding box."""
    lat, lon = F.col("latitude"), F.col("longitude")
    gap_lat, gap_lon = F.greatest(f["south"] - lat, lat - f["north"], F.lit(0.0)), F.greatest(f["west"] - lon, lon - f["east"], F.lit(0.0))
    return F.hypot(gap_lon * geo.LON_KM * F.cos(F.radians("latitude")), gap_lat * geo.LAT_KM)


def _measured(parts: Column) -> Column:
    """The least distance to the parts: 0 inside a ring, else that to a segment, in a plane about the point."""

    def of(p: Column) -> Column:
        crossings = F.aggregate(p["legs"], F.lit(0), lambda n, s: n + F.coalesce(_crosses(s), F.lit(False)).cast("int"))
        return F.when(p["ring"] & (crossings % 2 == 1), 0.0).otherwise(F.array_min(F.transform(p["legs"], _leg)))

    return F.array_min(F.transform(parts, of))


def _ends(s: Column) -> tuple[Column, Column, Column, Column]:
    scale = geo.LON_KM * F.cos(F.radians("latitude"))
    return (s["o1"] - F.col("longitude")) * scale, (s["a1"] - F.col("latitude")) * geo.LAT_KM, (s["o2"] - F.col("longitude")) * scale, (s["a2"] - F.col("latitude")) * geo.LAT_KM


def _leg(s: Column) -> Column:
    """The distance to a segment; a leg that closes a ring has none."""
    x1, y1, x2, y2 = _ends(s)
    dx, dy = x2 - x1, y2 - y1
    length = dx * dx + dy * dy
    t = F.when(length > 0, F.least(F.greatest(-(x1 * dx + y1 * dy) / length, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    return F.when(~s["closing"], F.hypot(x1 + t * dx, y1 + t * dy))


def _crosses(s: Column) -> Column:
    x1, y1, x2, y2 = _ends(s)
    return ((y1 > 0) != (y2 > 0)) & (x1 + (x2 - x1) * F.try_divide(-y1, y2 - y1) > 0)


def landcover(points: DataFrame, pixels: DataFrame, key: str, radius: float, expected: float | None = None) -> DataFrame:
    """(key, worldcover_dominant, worldcover_coverage, vegetation_fraction, built_fraction, bare_fraction).

    Points have tile, row and col (in pixels), pixels tile, px_row, px_col and code; those within ``radius``
    pixels count. Pixel blocks of the radius' size are the join's key, so a point meets the pixels around it only.
    Coverage is the share of ``expected`` pixels (default: of the disc) that were there.
    """
    step = max(1, int(radius) + 1)
    near = F.array(*(F.lit(i) for i in (-1, 0, 1)))
    p = points.select(F.col(key).alias("key"), "tile", "row", "col").withColumn("dr", F.explode(near)).withColumn("dc", F.explode(near))
    p = p.withColumns({"br": F.floor(F.col("row") / step) + F.col("dr"), "bc": F.floor(F.col("col") / step) + F.col("dc")})
    q = pixels.select("tile", "px_row", "px_col", "code", F.floor(F.col("px_row") / step).alias("br"), F.floor(F.col("px_col") / step).alias("bc"))
    inside = p.join(q, ["tile", "br", "bc"]).where(F.pow(F.col("px_row") - F.col("row"), 2) + F.pow(F.col("px_col") - F.col("col"), 2) <= radius * radius)
    counts = inside.where(F.col("code").isin(*LAND_COVER)).groupBy("key", "code").agg(F.count("*").alias("n"), F.min(F.struct("px_row", "px_col")).alias("first"))
    whole = expected or sum(1 for y in range(-step, step + 1) for x in range(-step, step + 1) if x * x + y * y <= radius * radius)
    names = F.lit(None).cast("string")
    for code, name in LAND_COVER.items():
        names = F.when(F.col("code") == code, name).otherwise(names)
    share = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0)) / F.sum("n")
    # of codes that tie, the one met first in row order
    rank = F.struct(F.col("n"), -F.col("first.px_row"), -F.col("first.px_col"))
    found = counts.withColumn("name", names).groupBy("key").agg(F.max_by("name", rank).alias("worldcover_dominant"), F.least(F.sum("n") / F.lit(float(whole)), F.lit(1.0)).alias("worldcover_coverage"), share(F.col("code").isin(*VEGETATION_CODES)).alias("vegetation_fraction"), share(F.col("code") == 50).alias("built_fraction"), share(F.col("code") == 60).alias("bare_fraction"))
    out = points.select(F.col(key).alias("key")).join(found, "key", "left")
    return out.withColumn("worldcover_coverage", F.coalesce("worldcover_coverage", F.lit(0.0))).withColumnRenamed("key", key)


def context_label(c: Context) -> Column:
    """The first rule that holds; land cover counts only where enough of it is known."""
    known = F.coalesce(F.col("worldcover_coverage") >= c.min_coverage, F.lit(False))
    green = F.when(known, F.col("vegetation_fraction"))
    developed = F.when(known, F.col("built_fraction") + F.col("bare_fraction")).otherwise(0.0)
    away = F.col("facility_distance_km")
    yes = lambda x: F.coalesce(x, F.lit(False))
    dense, close = yes(green >= c.vegetation_fraction), yes(away <= c.industrial_context_km)
    return (
        F.when(close & dense, "mixed")
        .when(yes(away <= c.industrial_near_km) & yes(developed >= 0.1), "industrial_associated")
        .when(dense, "vegetation_associated")
        .when(close | yes(green >= 0.4), "mixed")
        .otherwise("unknown")
    )


def assign_context(events: DataFrame, c: Context) -> DataFrame:
    """Events with context_label, context_conflict (both kinds of evidence, the raw vegetation share counting) and the year of the land cover."""
    both = (F.col("facility_distance_km") <= c.industrial_context_km) & (F.col("vegetation_fraction") >= c.vegetation_fraction)
    return events.withColumn("context_label", context_label(c)).withColumns({"context_conflict": (F.col("context_label") == "mixed") & F.coalesce(both, F.lit(False)), "landcover_reference_year": F.lit(2021), "context_time_warning": F.lit("Facilities are of today and land cover is of 2021, not of the time of the event.")})
