"""Readers, writers and the streaming face, on small files."""

import json

from pyspark.sql import functions as F

from emberflow.config import Settings
from emberflow.operators import ingest
from emberflow.sources import readers, sinks
from emberflow.streaming import live

HEADER = "latitude,longitude,acq_date,acq_time,satellite,version,frp,bright_ti4,bright_ti5\n"
AS_OF = "2024-06-01 00:00:00"


def test_csv_with_sidecars(spark, tmp_path):
    (tmp_path / "a.csv").write_text(HEADER + "24,82,2024-01-01,100,N,x,5,340,300\n")
    (tmp_path / "a.meta.json").write_text(json.dumps({"url": "u", "retrieved_at": "t", "data_quality": "archive"}))
    (tmp_path / "b.csv").write_text(HEADER + "24.1,82,2024-01-01,100,N,2,5,340,300\n")
    path = f"file://{tmp_path}"
    rows = readers.with_sidecars(readers.detection_files(spark, path), readers.sidecars(spark, path))
    got = {r.latitude: r for r in ingest.ingest(rows, Settings(), AS_OF).collect()}
    assert (got[24.0].data_quality, got[24.0].source_url, got[24.1].data_quality, got[24.1].source_url) == ("archive", "u", "science_quality", None)


def test_map_elements(spark, tmp_path):
    doc = {"elements": [{"type": "way", "id": 7, "tags": {"landuse": "quarry", "name": "Q"}, "geometry": [{"lat": 24.0, "lon": 82.0}, {"lat": 24.0, "lon": 83.0}]}, {"type": "node", "id": 8, "lat": 23.0, "lon": 82.0, "tags": {"power": "plant", "landuse": "x"}}, {"type": "relation", "id": 9, "members": [{"geometry": [{"lat": 1.0, "lon": 2.0}]}, {}]}, {"type": "node", "id": 10}]}
    (tmp_path / "m.json").write_text(json.dumps(doc))
    elements = readers.map_elements(spark, f"file://{tmp_path}/m.json")
    got = {r.facility_id: r for r in readers.facilities(elements).collect()}
    assert {k: (v.name, v.kind, v.longitude) for k, v in got.items()} == {"osm:way:7": ("Q", "landuse=quarry", 82.5), "osm:node:8": ("Unnamed mapped feature", "power=plant", 82.0), "osm:relation:9": ("Unnamed mapped feature", "industrial_context", 2.0)}
    assert [(r.osm_id, r.coordinates) for r in readers.roads(elements).collect()] == [(7, [[82.0, 24.0], [83.0, 24.0]])]


def test_geojson_and_details(spark, tmp_path):
    df = spark.createDataFrame([(i, 24.0, 82.0, float("nan") if i == 1 else 0.5) for i in range(600)], "event_id bigint, latitude double, longitude double, anomaly_score double")
    sinks.geojson_lines(df, f"file://{tmp_path}/g", "event_id")
    rows = [json.loads(r.value) for r in spark.read.text(f"file://{tmp_path}/g").collect()]
    one = next(r for r in rows if r["id"] == "1")
    assert one["geometry"] == {"type": "Point", "coordinates": [82.0, 24.0]} and one["properties"] == {"event_id": 1, "anomaly_score": None}
    summary = sinks.details(df, f"file://{tmp_path}/d")
    assert {(r.event_id, r.shard, r.shard_index) for r in summary.collect()} == {(i, i // 256, i % 256) for i in range(600)}
    (tmp_path / "c.json").write_text(json.dumps({"features": rows[:3]}))
    assert readers.geojson(spark, f"file://{tmp_path}/c.json", "event_id: bigint, anomaly_score: double").count() == 3
    schema = "features array<struct<id: string>>"
    assert readers.optional(spark, f"file://{tmp_path}/none.json", schema)[1] == "not_cached"
    assert readers.optional(spark, f"file://{tmp_path}/c.json", schema)[1] == "cached"


def test_stream_upserts(spark, tmp_path):
    source, target = tmp_path / "in", f"file://{tmp_path}/out"
    source.mkdir()
    schema = ", ".join(f"{c} string" for c in HEADER.strip().split(","))

    def run():
        live.run(live.detection_stream(spark, f"file://{source}", schema), target, f"file://{tmp_path}/cp", Settings(), AS_OF).awaitTermination()
        return {(r.latitude, r.data_quality, r.frp) for r in spark.read.parquet(target).collect()}

    (source / "a.csv").write_text(HEADER + "24,82,2024-01-01,100,N,2.0NRT,5,340,300\n24.1,82,2024-01-02,100,N,2.0NRT,5,340,300\n")
    assert run() == {(24.0, "near_real_time", 5.0), (24.1, "near_real_time", 5.0)}
    (source / "b.csv").write_text(HEADER + "24,82,2024-01-01,100,N,2,7,340,300\n")
    assert run() == {(24.0, "science_quality", 7.0), (24.1, "near_real_time", 5.0)}


def test_hourly_counts_are_a_plan(spark):
    df = spark.createDataFrame([("VIIRS_SNPP", 1.0)], "sensor string, frp double").withColumn("acquired_at", F.lit("2024-01-01 10:20:00").cast("timestamp"))
    assert live.hourly_counts(df).first().n == 1


def test_csv_files_are_read_by_their_own_headers(spark, tmp_path):
    import pytest

    (tmp_path / "a b.csv").write_text(HEADER + "24,82,2024-01-01,100,N,2,5,340,300\n")
    (tmp_path / "c.csv").write_text("satellite,brightness,bright_t31,acq_time,acq_date,longitude,latitude,extra\nTerra,330,290,130,2024-01-02,83,25,e\n")
    rows = {r.source_file.rsplit("/", 1)[-1]: r for r in readers.detection_files(spark, f"file://{tmp_path}").collect()}
    a, c = rows["a%20b.csv"], rows["c.csv"]
    assert (a.latitude, a.longitude, a.satellite, a.instrument, a.bright_ti4, a.brightness, a.extra) == ("24", "82", "N", "VIIRS", "340", None, None)
    assert (c.latitude, c.longitude, c.satellite, c.instrument, c.bright_ti4, c.brightness, c.extra) == ("25", "83", "Terra", "MODIS", None, "330", "e")
    got = ingest.ingest(readers.detection_files(spark, f"file://{tmp_path}"), Settings(), AS_OF).collect()
    assert {(r.latitude, r.longitude) for r in got} <= {(24.0, 82.0), (25.0, 83.0)} and len(got) >= 1
    (tmp_path / "d.csv").write_text("latitude,longitude\n1,2\n")
    with pytest.raises(ValueError, match="d.csv.*missing"):
        readers.detection_files(spark, f"file://{tmp_path}")


def test_stream_refuses_another_header(spark, tmp_path):
    import pytest

    source = tmp_path / "in"
    source.mkdir()
    (source / "x.csv").write_text("longitude,latitude," + HEADER.split(",", 2)[2] + "82,24,2024-01-01,100,N,2,5,340,300\n")
    schema = ", ".join(f"{c} string" for c in HEADER.strip().split(","))
    stream = live.detection_stream(spark, f"file://{source}", schema)
    with pytest.raises(Exception, match="(?i)header"):
        live.run(stream, f"file://{tmp_path}/out", f"file://{tmp_path}/cp", Settings(), AS_OF).awaitTermination()
