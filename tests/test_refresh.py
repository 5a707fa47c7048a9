"""Parts of saved results computed anew, documents, checks before a run, and the joins of peers and scenes against brute force."""

import gzip
import json
import math
import random
from dataclasses import asdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from test_contracts import DETECTION, EPISODE, S, detection, episode, peer_rows

from emberflow.config import Area, Evidence, Models, Peers, Settings
from emberflow.functions import geo, text
from emberflow.operators import context, decision, evidence, peers, refresh, reports, scores, serving, tuning
from emberflow.sources import readers, sinks


def saved(spark):
    df = spark.createDataFrame(peer_rows(), EPISODE).withColumn("anomaly_score", F.lit(None).cast("double"))
    p = Peers(season_window_days=60)
    return decision.decide(peers.score_peers(df, p, S.area), S.models), Settings(peers=p)


def rows_of(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


# ---- refreshes


def test_interpretation_refresh(spark):
    events, s = saved(spark)
    stale = events.withColumns({"decision": F.lit("old"), "score_reason": F.lit("old")})
    new = refresh.interpretation(stale, asdict(s.models), s.models, events)
    assert new.columns == stale.columns and rows_of(new) == rows_of(events)
    assert refresh.changed(stale, new, refresh.INTERPRETATION).isEmpty()
    assert not refresh.changed(stale, new.withColumn("frp_peak_mw", F.lit(0.0)), refresh.INTERPRETATION).isEmpty()
    with pytest.raises(refresh.Refused, match="models"):
        refresh.interpretation(stale, {}, s.models)
    with pytest.raises(refresh.Refused, match="disagree"):
        refresh.interpretation(stale, asdict(s.models), s.models, events.withColumn("anomaly_score", F.lit(0.1)))
    with pytest.raises(refresh.Refused, match="twice"):
        refresh.interpretation(stale.union(stale), asdict(s.models), s.models, events)


def test_peer_refresh(spark):
    events, s = saved(spark)
    stale = events.withColumns({"anomaly_score": F.lit(None).cast("double"), "peer_status": F.lit("old"), "decision_basis": F.lit("old")})
    new = refresh.peer_scores(stale, stale, s)
    assert rows_of(new.select("event_id", "anomaly_score", "peer_status", "peer_reference_hash", "decision_basis", "decision")) == rows_of(events.select("event_id", "anomaly_score", "peer_status", "peer_reference_hash", "decision_basis", "decision"))
    with pytest.raises(refresh.Refused, match="disagree"):
        refresh.peer_scores(stale, stale.withColumn("latitude", F.col("latitude") + 1e-9), s)
    with pytest.raises(refresh.Refused, match="lacks"):
        refresh.peer_scores(stale, stale.drop("frp_peak_mw"), s)
    with pytest.raises(refresh.Refused, match="only_left"):
        refresh.peer_scores(stale, stale.where("event_id <> 'TARGET'"), s)


def test_evidence_refresh(spark):
    events, s = saved(spark)
    old = events.withColumn("sentinel_evidence", F.lit("old"))
    found = spark.createDataFrame([("TARGET", "no_clear_change"), ("TARGET", "observed_swir_change"), ("gone", "x")], "event_id string, sentinel_evidence string")
    got = {r.event_id: r for r in refresh.evidence(old, found, s.models).collect()}
    assert len(got) == events.count() and got["TARGET"].sentinel_evidence == "no_clear_change" and "sentinel=no_clear_change" in got["TARGET"].decision_basis
    assert {r.sentinel_evidence for k, r in got.items() if k != "TARGET"} == {None}


# ---- joins against brute force


def test_peer_references_match_brute_force(spark):
    rng = random.Random(4)
    area, p = Area(west=-179.0, south=60.0, east=179.5, north=71.0), Peers(min_events=1, radius_km=150.0, season_window_days=20, history_window_days=900)
    rows = [episode(f"e{i:03}", rng.randrange(1500), lat=rng.uniform(60, 71), lon=rng.choice([rng.uniform(-3, 3), rng.uniform(-179, -177), rng.uniform(177.5, 179.5)])) for i in range(400)]
    df = spark.createDataFrame(rows, EPISODE).withColumn("anomaly_score", F.lit(None).cast("double"))
    got = {(r.target_id, r.event_id) for r in peers.references(peers.judged(df, p, area), p, area).collect()}

    def km(a, b):
        h = math.sin(math.radians(b[6] - a[6]) / 2) ** 2 + math.cos(math.radians(a[6])) * math.cos(math.radians(b[6])) * math.sin(math.radians(b[7] - a[7]) / 2) ** 2
        return 2 * geo.EARTH_KM * math.asin(math.sqrt(min(1, h)))

    def season(a, b):
        d = abs(a[4].timetuple().tm_yday - b[4].timetuple().tm_yday)
        return min(d, 366 - d)

    want = set()
    for t in rows:
        first = datetime(t[4].year, t[4].month, t[4].day) - timedelta(days=p.gap_days)
        met = [r for r in rows if r[5] < first and r[4] >= t[4] - timedelta(days=900) and season(r, t) <= 20 and 2 < km(r, t) <= 150]
        want |= {(t[0], r[0]) for r in met}
    # one a cell and day: with so few rows no two share both
    assert got == want and len(want) > 30


def scenes_and_events(spark, seed=2):
    rng = random.Random(seed)
    day = datetime(2023, 1, 1)
    scenes = []
    for i in range(400):
        west, south = rng.choice([80.5, 81.5, 82.0]), rng.choice([22.5, 23.5])
        scenes.append((f"s{i:03}", rng.choice(["sentinel-2-c1-l2a", "sentinel-2-l2a"]), f"t{rng.randrange(2)}", day + timedelta(days=rng.randrange(120), hours=10), float(rng.choice([0, 10, 10, 60, 90])), rng.choice(["nir", "nir08"]), west, south, west + 1.2, south + 1.2))
    events = [(i, day + timedelta(days=rng.randrange(20, 90)), rng.uniform(22.5, 24.7), rng.uniform(80.5, 83.2)) for i in range(60)]
    events = [(i, t, t + timedelta(hours=5), la, lo) for i, t, la, lo in events]
    return scenes, events, spark.createDataFrame(scenes, "scene_id string, collection string, tile string, at timestamp_ntz, cloud double, nir string, west double, south double, east double, north double"), spark.createDataFrame(events, "event_id bigint, start_time timestamp_ntz, end_time timestamp_ntz, latitude double, longitude double")


def test_scenes_and_pairs_match_brute_force(spark):
    scenes, events, sdf, edf = scenes_and_events(spark)
    e = Evidence(max_scenes_per_side=3)
    sided = evidence.usable_scenes(edf, sdf, e, "2023-04-20 00:00:00")
    want = set()
    for i, start, end, lat, lon in events:
        lanes = {}
        for s in sorted(scenes):
            if s[3] > datetime(2023, 4, 20) or s[4] > 70 or not (s[6] <= lon <= s[8] and s[7] <= lat <= s[9]):
                continue
            side = "pre" if start - timedelta(days=45) <= s[3] < start else "post" if end < s[3] <= end + timedelta(days=30) else None
            if side:
                lanes.setdefault((s[1], s[2], side), {}).setdefault(s[3], s)  # the first scene of a time
        for (c, t, side), by_time in lanes.items():
            near = sorted(by_time.values(), key=lambda s: (abs((start if side == "pre" else end) - s[3]), s[4], s[0]))[:3]
            want |= {(i, c, t, side, s[0]) for s in near}
    assert {(r.event_id, r.collection, r.tile, r.side, r.scene_id) for r in sided.collect()} == want and len(want) > 100
    every = evidence.scene_pairs(sided, e)
    for best in (1, 2, 4, 7):
        assert rows_of(evidence.scene_pairs(sided, e, best)) == rows_of(every.where(F.col("pair_rank") <= best))


# ---- documents and readers


def test_collection_is_one_document(spark, tmp_path):
    df = spark.range(500).select(F.col("id").alias("event_id"), F.lit(24.0).alias("latitude"), F.lit(82.0).alias("longitude"), F.array(F.lit(float("inf")), F.lit(1.5)).alias("values"), F.struct(F.lit(float("nan")).alias("a.b"), F.lit("x").alias("c")).alias("odd.name"), F.lit(datetime(2024, 1, 2)).cast("timestamp_ntz").alias("t"))
    for kind, read in (("none", open), ("gzip", gzip.open)):
        where = f"file://{tmp_path}/{kind}"
        sinks.collection(df.repartition(3), where, "event_id", kind)
        sinks.joined(spark, where, f"{where}.json")
        doc = json.load(read(f"{tmp_path}/{kind}.json"))
        assert doc["type"] == "FeatureCollection" and [f["id"] for f in doc["features"]] == [str(i) for i in range(500)]
        assert doc["features"][7]["properties"] == {"event_id": 7, "values": [None, 1.5], "odd.name": {"a.b": None, "c": "x"}, "t": "2024-01-02T00:00:00.000"}
    sinks.collection(df.limit(0), f"file://{tmp_path}/e", "event_id")
    sinks.joined(spark, f"file://{tmp_path}/e", f"file://{tmp_path}/e.json")
    assert json.load(open(f"{tmp_path}/e.json")) == {"type": "FeatureCollection", "features": []}
    rows, status = readers.optional_geojson(spark, f"file://{tmp_path}/none.json", "event_id: bigint")
    assert (rows.count(), status) == (500, "cached")
    assert readers.optional_geojson(spark, f"file://{tmp_path}/e.json", "event_id: bigint")[1] == "empty_cache"
    (tmp_path / "bad.json").write_text('{"type": "Topology", "features": [{}]}')
    (tmp_path / "broken.json").write_text('{"type": ')
    assert [readers.optional_geojson(spark, f"file://{tmp_path}/{n}.json", "event_id: bigint")[1] for n in ("bad", "broken", "missing")] == ["invalid_cache", "unreadable_cache", "not_cached"]


def test_results_read_again(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.1 + 0.2, datetime(2024, 1, 2, 3, 4, 5), "a,\"b"), (2, None, None, None)], "event_id bigint, v double, t timestamp_ntz, s string")
    sinks.csv(df, f"file://{tmp_path}/r")
    assert rows_of(readers.results(spark, f"file://{tmp_path}/r", "event_id bigint, v double, t timestamp_ntz, s string")) == rows_of(df)
    sinks.ranking(df.withColumn("anomaly_score", F.col("v")), f"file://{tmp_path}/k")
    assert [r.event_id for r in spark.read.option("header", True).csv(f"file://{tmp_path}/k").collect()] == ["1"]
    with pytest.raises(Exception, match="(?i)malformed|cast|parse|header"):
        readers.results(spark, f"file://{tmp_path}/r", "event_id bigint, v double, t double, s string").collect()


def test_preflight(spark, tmp_path):
    head = "latitude,longitude,acq_date,acq_time,satellite,bright_ti4\n"
    (tmp_path / "good.csv").write_text(head)
    (tmp_path / "bad.csv").write_text("latitude,longitude\n1,2\n")
    area = Area(west=81.5, south=23.2, east=84.5, north=25.2)
    assert {r.tile for r in readers.area_tiles(spark, area).collect()} == {"N21E081", "N21E084", "N24E081", "N24E084"}
    pixels = spark.createDataFrame([("N21E081",), ("N24E081",), ("N24E084",)], "tile string")
    got = {(r.check, r.subject.rsplit("/", 1)[-1]) for r in readers.preflight(spark, f"file://{tmp_path}", spark.createDataFrame([], "a int"), pixels, area).collect()}
    assert got == {("invalid_header", "bad.csv"), ("no_facilities", ""), ("missing_tile", "N21E084")}


def test_download_rules(spark):
    tag = "900150983cd24fb0d6963f7d28e17f72"  # MD5 of "abc"
    rows = [("abc", f'"{tag}"', True), ("abc", f'"{tag.upper()}"', True), ("abd", f'"{tag}"', False), ("abc", f'W/"{tag}"', False), ("abc", None, False), (None, f'"{tag}"', False)]
    df = spark.createDataFrame(rows, "c string, e string, want boolean")
    assert df.where(readers.recoverable(F.col("c").cast("binary"), F.col("e")) != F.col("want")).isEmpty()
    first = "https://host.example/search"
    rows = [("https://HOST.example/next?p=2", True), ("https://host.example", True), ("http://host.example/n", False), ("https://host.example.evil/n", False), ("https://host.example@evil/n", False), ("https://host.example:444/n", False), ("/relative", False), (None, False)]
    df = spark.createDataFrame([(a, first, w) for a, w in rows], "a string, f string, want boolean")
    assert df.where(readers.may_follow(F.col("a"), F.col("f")) != F.col("want")).isEmpty()


def test_utm_grid(spark):
    df = spark.createDataFrame([(43.642567, -79.387139), (0.0, 3.0), (-33.8567844, 151.2152967)], "lat double, lon double")
    g = [r.g for r in df.select(geo.snapped_grid(F.col("lat"), F.col("lon"), 500).alias("g")).collect()]
    # a tower whose position in UTM is widely published, the equator on a central meridian, and a place in the south
    assert g[0].epsg == 32617 and abs(g[0].x - 630084) < 1.5 and abs(g[0].y - 4833438) < 1.5
    assert g[1].epsg == 32631 and abs(g[1].x - 500000) < 1e-6 and abs(g[1].y) < 1e-6 and g[1].top == 500 and g[1].left in (499480, 499500)
    assert g[2].epsg == 32756 and abs(g[2].x - 334900) < 200 and abs(g[2].y - 6252290) < 300
    assert all(x.left <= x.x - 500 < x.left + 20 and x.top - 20 < x.y + 500 <= x.top and x.rows * 20 >= x.top - x.y + 500 for x in g)
    with pytest.raises(ValueError, match="grid"):
        geo.snapped_grid(F.col("lat"), F.col("lon"), 20_000)


def test_previews_times_and_notes(spark):
    rows = [("C:\\out\\sentinel\\a\\p.png", "sentinel/a/p.png"), ("/x/sentinel/../q.png", "/x/sentinel/../q.png"), ("sentinel/p.png", "sentinel/p.png"), (None, None)]
    df = spark.createDataFrame(rows, "c string, want string")
    assert df.where(~text.portable_preview(F.col("c")).eqNullSafe(F.col("want"))).isEmpty()
    times = spark.createDataFrame([("2024-01-01T00:00:00Z", datetime(2024, 1, 1)), ("2024-01-01T05:30:00+05:30", datetime(2024, 1, 1)), ("2024-01-01 00:00:00", datetime(2024, 1, 1)), ("", None), ("true", None)], "c string, want timestamp_ntz")
    assert times.where(~serving.lenient_time(F.col("c")).eqNullSafe(F.col("want"))).isEmpty()
    events = spark.createDataFrame([(datetime(2024, 1, 2), datetime(2024, 1, 5)), (datetime(2024, 1, 1), None)], "start_time timestamp_ntz, end_time timestamp_ntz")
    assert tuple(serving.time_span(events).first()) == (datetime(2024, 1, 1), datetime(2024, 1, 5))
    audit = spark.createDataFrame([("2023-12-31T00:00:00Z", "no date")], "date_min string, date_max string")
    assert tuple(serving.time_span(events, audit).first()) == (datetime(2023, 12, 31), datetime(2024, 1, 5))
    bands = spark.createDataFrame([(None, "Insufficient data"), (0.99, "Highest priority"), (0.95, "High priority"), (0.8, "Moderate priority"), (0.1, "Lower priority")], "s double, want string")
    assert bands.where(serving.score_band(F.col("s")) != F.col("want")).isEmpty()
    allowed = spark.createDataFrame([("analysed", None, True), ("analysed", "legacy_offset_unverified", False), ("queued", None, False), (None, None, False)], "s string, r string, want boolean")
    assert allowed.where(serving.imagery_numbers_allowed(F.col("s"), F.col("r")) != F.col("want")).isEmpty()


# ---- baselines


def test_baselines_equal_the_joined_history(spark):
    rng = random.Random(9)
    rows = [episode(f"e{i}", rng.choice([rng.randrange(400), 7]), site=rng.choice(["S1", "S1", "S2", ""]), frp=rng.choice([None, 5.0, rng.uniform(1, 50)]), sensor=rng.choice(["VIIRS_SNPP", "VIIRS_NOAA20"]), quality=rng.choice(["science_quality"] * 4 + ["near_real_time"]), hours=rng.choice([1, 2, 90])) for i in range(500)]
    df = scores.prepared(spark.createDataFrame(rows, EPISODE).unionByName(spark.createDataFrame([("bare", "S1")], "event_id string, site_id string"), allowMissingColumns=True))
    keep = ["event_id", "history_event_count", "baseline_mode", "baseline_start", "baseline_end", "days_since_previous", "model_feature_count", "robust_anomaly_raw", *(f"past_z_{f}" for f in scores.FEATURES)]
    for m in (Models(history_window_days=60, min_history_events=4, seasonal_window_days=20, seasonal_min_events=6), Models(history_window_days=2557), Models(min_history_events=7, seasonal_window_days=0)):
        want = {r.event_id: r for r in scores.robust_z(scores.history(df, m), m).select(keep).collect()}
        got = {r.event_id: r for r in scores.baselines(df, m).select(keep).collect()}
        assert set(got) == set(want) and {r.baseline_mode for r in want.values()} >= {"insufficient_history", "rolling_same_sensor_and_daynight"}
        for k, w in want.items():
            assert [x for x in got[k] if not isinstance(x, float)] == [x for x in w if not isinstance(x, float)], k
            assert [x for x in got[k] if isinstance(x, float)] == pytest.approx([x for x in w if isinstance(x, float)], rel=1e-9, abs=1e-9), k
    assert scores.baselines(df.limit(0), Models()).isEmpty()


# ---- facilities


def test_nearest_facility_matches_brute_force(spark):
    rng = random.Random(3)
    for base in (0.0, -33.0, 64.0):
        pts = [(i, base + rng.uniform(-0.4, 0.4), rng.uniform(-0.5, 0.5)) for i in range(150)] + [(900, None, 1.0), (901, base, -0.5), (902, base + 5, 3.0)]
        fac = [(k, f"f{k}", "n", "k", [[(base + rng.uniform(-0.5, 0.5), rng.uniform(-0.6, 0.6))]]) for k in range(40)]
        fac.append((99, "line", "n", "k", [[(base - 0.3, -0.6), (base + 0.3, 0.6)]]))
        pdf = spark.createDataFrame(pts, "event_id bigint, latitude double, longitude double")
        fdf = spark.createDataFrame(fac, "fac_ord bigint, facility_id string, name string, kind string, parts array<array<struct<lat: double, lon: double>>>")
        got = {r.event_id: r for r in context.nearest_facility(pdf, fdf).collect()}
        assert got[900].facility_distance_km is None and got[900].nearest_facility_id == ""
        for i, lat, lon in pts:
            if lat is None:
                continue
            scale = geo.LON_KM * math.cos(math.radians(lat))
            away = []
            for k, name, _, _, ((first, *rest),) in fac:
                x, y = (first[1] - lon) * scale, (first[0] - lat) * geo.LAT_KM
                d = math.hypot(x, y)
                if rest:
                    dx, dy = (rest[0][1] - first[1]) * scale, (rest[0][0] - first[0]) * geo.LAT_KM
                    t = min(1, max(0, -(x * dx + y * dy) / (dx * dx + dy * dy)))
                    d = math.hypot(x + t * dx, y + t * dy)
                away.append((d, k, name))
            assert got[i].facility_distance_km == pytest.approx(min(away)[0], abs=1e-9) and got[i].nearest_facility_id == min(away)[2]


def test_candidates_without_a_cap_equal_a_cap_of_all(spark):
    rng = random.Random(5)
    day = datetime(2023, 1, 1)
    rows = [(i, rng.choice(["S1", "S2", ""]), day + timedelta(days=rng.randrange(900)), 82.0 + i % 3, 24.0, rng.choice([None, rng.random()]), rng.choice([None, 5.0]), rng.choice(["industrial_associated", "mixed", "vegetation_associated", "unknown"])) for i in range(200)]
    df = spark.createDataFrame(rows, "event_id bigint, site_id string, start_time timestamp_ntz, longitude double, latitude double, anomaly_score double, frp_peak_mw double, context_label string")
    for policy in ("priority", "all"):
        every, capped = (evidence.select_candidates(df, Evidence(max_events=n, candidate_policy=policy), 0.5, "2025-06-01 00:00:00") for n in (None, 200))
        assert rows_of(every) == rows_of(capped) and (every.count() == 200) == (policy == "all")
    chosen = evidence.select_candidates(df, Evidence(max_events=None), 0.5, "2025-06-01 00:00:00", ["3", "4", "none"])
    assert {tuple(r) for r in chosen.collect()} == {(3, "explicit_selection"), (4, "explicit_selection")}


# ---- small pieces


def test_parameter_search(spark, monkeypatch):
    monkeypatch.setattr(tuning, "EVENT_KM", (2.0,))
    monkeypatch.setattr(tuning, "EVENT_HOURS", (24.0, 36.0))
    monkeypatch.setattr(tuning, "SITE_KM", (1.5,))
    s = Settings(models=Models(tuning_repeats=2))
    rows = [detection(f"d{i}{k}", "VIIRS_SNPP", 5.0, hours=100.0 * i + k, lat=23.5 + 0.1 * (i % 4)) for i in range(12) for k in range(3)]
    trials = tuning.tune_events(spark.createDataFrame(rows, DETECTION), s)
    got = {r.event_temporal_hours: r for r in trials.collect()}
    assert set(got) == {24.0, 36.0} and all(r.events == 12 and r.spatial_compliance == r.temporal_compliance == 1 and r.subsample_ari > 0.9 for r in got.values())
    assert tuning.best(trials, tuning.event_objective()).count() == 1
    eps = spark.createDataFrame([episode(f"e{i}", i, lat=23.5 + 0.1 * (i % 3)) for i in range(18)], EPISODE).withColumn("detection_count", F.lit(2).cast("bigint"))
    one = tuning.tune_sites(eps, s).withColumn("objective", tuning.site_objective()).first()
    assert (one.sites, one.event_coverage, one.subsample_ari) == (3, 1.0, 1.0)
    assert one.objective == pytest.approx(0.75 + 0.25 - 0.03 * 0.75)


def test_notes_keys_and_months(spark):
    years = spark.createDataFrame([(2021,), (2019,), (2021,)], "year int")
    assert reports.coverage_note(years).first().note.startswith("Missing years: 2019, 2021. ")
    assert reports.coverage_note(years.limit(0)).first().note.startswith("Coverage has gaps")
    keys = spark.createDataFrame([("a|b", "c"), ("a", "b|c"), ("a", None), (None, "a"), ("a", "")], "x string, y string").select(evidence.cache_key(F.col("x"), F.col("y")).alias("k"))
    assert keys.distinct().count() == 5
    m = spark.createDataFrame([(datetime(2024, 1, 31, 5), datetime(2024, 12, 2))], "a timestamp_ntz, b timestamp_ntz").select(evidence.catalogue_month(F.col("a"), F.col("b")).alias("m")).first().m
    assert (str(m.month_from), str(m.month_to)) == ("2024-01-01", "2025-01-01")
