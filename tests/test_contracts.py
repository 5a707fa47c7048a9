"""Contracts of the operators on small inputs: golden values, invariances and brute force."""

import itertools
import random
from dataclasses import replace
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberflow.config import Evidence, Models, Peers, Settings
from emberflow.operators import clustering, context, decision, events, evidence, forest, governance, ingest, peers, scores, serving, tuning
from emberflow.plans import analysis

S = Settings()
DAY0 = datetime(2023, 1, 1)
EPISODE = "event_id string, site_id string, model_sensor string, model_daynight string, start_time timestamp_ntz, end_time timestamp_ntz, latitude double, longitude double, data_quality string, context_label string, worldcover_dominant string, worldcover_coverage double, frp_peak_mw double, frp_median_mw double, detection_peak double, duration_hours double, spread_km double, brightness_temperature_difference_max double"


def episode(i, day, site="S1", frp=10.0, sensor="VIIRS_SNPP", quality="science_quality", lat=24.0, lon=82.0, hours=2):
    start = DAY0 + timedelta(days=day)
    return (i, site, sensor, "D", start, start + timedelta(hours=hours), lat, lon, quality, "vegetation_associated", "tree_cover", 1.0, frp, frp, 2.0, float(hours), 1.0, 20.0)


# ---- ingest

RAW = "latitude string, longitude string, acq_date string, acq_time string, satellite string, version string, frp string, confidence string, bright_ti4 string, bright_ti5 string, source_retrieved_at string"


def test_ingest_rules(spark):
    rows = [
        ("24", "82", "2024-01-01", "120", "N", "2", "8", "n", "340", "300", "1"),
        ("24", "82", "2024-01-01", "0120.0", "SNPP", "2.0NRT", "9", "h", "341", "300", "2"),  # the same, newer, but near real time
        ("24.5", "82", "2024-01-01", "12345", "N", "2", "8", "n", "340", "300", "1"),
        ("24.5", "82", "2099-01-01", "0100", "N", "2", "8", "n", "340", "300", "1"),
        ("95", "82", "2024-01-01", "0100", "N", "2", "8", "n", "340", "300", "1"),
        ("24.6", "82", "2024-01-01", "0100", "N21", "2", "8", "n", "340", "300", "1"),
        ("24.7", "82", "2024-01-01", "2359", "J1", "x", "0", "80", "bad", "300", "1"),
    ]
    raw = spark.createDataFrame(rows, RAW)
    got = {r.latitude: r for r in ingest.ingest(raw, S, "2024-06-01 00:00:00").collect()}
    assert set(got) == {24.0, 24.7}
    a, b = got[24.0], got[24.7]
    assert (a.frp, a.data_quality, a.sensor, a.brightness_temperature_difference, a.confidence_score) == (8.0, "science_quality", "VIIRS_SNPP", 40.0, 0.6)
    assert (b.frp, b.data_quality, b.brightness, b.confidence_score, b.acquired_at) == (None, "unknown", None, 0.8, datetime(2024, 1, 1, 23, 59))
    assert a.detection_id.startswith("D") and len(a.detection_id) == 17
    with pytest.raises(ValueError, match="acq_time"):
        ingest.check_header(["latitude", "longitude", "acq_date", "satellite"])


# ---- clustering


def test_density_clusters_against_brute_force(spark):
    rnd = random.Random(1)
    pts = [(i, rnd.uniform(0, 6), rnd.uniform(0, 6)) for i in range(120)]
    df = spark.createDataFrame(pts, "key bigint, x double, y double")
    near = {a: {b for b in range(120) if (pts[a][1] - pts[b][1]) ** 2 + (pts[a][2] - pts[b][2]) ** 2 <= 0.36} for a in range(120)}
    scaled = df.select("key", (F.col("x") / 0.6).alias("x"), (F.col("y") / 0.6).alias("y"))
    for least in (2, 4):
        core = {a for a in near if len(near[a]) >= least}
        label = {a: a for a in core}
        for _ in range(120):
            for a in core:
                label[a] = min(label[b] for b in near[a] & core)
        want = {a: label[a] if a in core else min((label[b] for b in near[a] & core), default=a) for a in near}
        assert {r.key: r.component for r in clustering.density_clusters(scaled, "key", ("x", "y"), least).collect()} == want


def test_complete_linkage_against_brute_force():
    rng = np.random.default_rng(3)
    for n in (1, 2, 8, 25):
        xy = rng.uniform(0, 4, (n, 2))
        groups = [[i] for i in range(n)]
        far = lambda g, h: max(np.hypot(*(xy[a] - xy[b])) for a in g for b in h)
        while len(groups) > 1:
            d, i, j = min((far(groups[i], groups[j]), i, j) for i, j in itertools.combinations(range(len(groups)), 2))
            if not d < 1.5:
                break
            groups[i] += groups.pop(j)
        label = clustering.complete_linkage(xy, 1.5)
        got = {frozenset(np.flatnonzero(label == k).tolist()) for k in set(label.tolist())}
        assert got == {frozenset(g) for g in groups}


def test_episodes_end_at_the_span_not_at_gaps(spark):
    hours = [0, 10, 24, 25, 40, 49, 50]
    rows = [(i, 1, DAY0 + timedelta(hours=h)) for i, h in enumerate(hours)] + [(100, 2, DAY0)]
    m = spark.createDataFrame(rows, "key bigint, component bigint, t timestamp_ntz")
    assert {r.key: r.episode for r in clustering.episodes(m, 24).collect()} == {0: 0, 1: 0, 2: 0, 3: 1, 4: 1, 5: 1, 6: 2, 100: 0}
    folded = m.where("component = 1").agg(F.array_sort(F.collect_list(F.struct("t", "key"))).alias("a")).select(F.explode(clustering.episode_starts(F.col("a"), 24)).alias("e"))
    assert {r.e.key: r.e.episode for r in folded.collect()} == {0: 0, 1: 0, 2: 0, 3: 1, 4: 1, 5: 1, 6: 2}


DETECTION = "detection_id string, acquired_at timestamp_ntz, latitude double, longitude double, sensor string, frp double, brightness double, brightness_temperature_difference double, daynight string, confidence_score double, firms_type_reference double, data_quality string"


def detection(i, sensor, frp, hours=0.0, lat=24.0, phase="D"):
    return (i, DAY0 + timedelta(hours=hours), lat, 82.0, sensor, frp, 300.0, 10.0, phase, 0.6, None, "science_quality")


def test_representative_platform(spark):
    rows = [detection("a", "VIIRS_SNPP", 5.0), detection("b", "VIIRS_SNPP", 5.0), detection("c", "VIIRS_NOAA20", 100.0, 1), detection("d", "MODIS_TERRA", None, 2), detection("far", "VIIRS_SNPP", None, 0, 25.0)]
    out, ev = events.cluster_events(spark.createDataFrame(rows, DETECTION), S)
    got = {r.detection_count: r for r in ev.collect()}
    e = got[4]
    assert (e.model_sensor, e.frp_peak_mw, e.frp_peak_all_sensors_mw, e.detection_peak, e.modis_frp_peak_mw) == ("VIIRS_SNPP", 10.0, 100.0, 2, None)
    assert e.detected_sensors == "MODIS_TERRA|VIIRS_NOAA20|VIIRS_SNPP" and got[1].frp_peak_mw is None
    assert {r.event_id for r in out.collect()} == {r.event_id for r in ev.collect()}


def test_sites_keep_their_diameter(spark):
    rows = [(f"e{i}", DAY0 + timedelta(days=i), DAY0 + timedelta(days=i, hours=1), 24.0 + 0.004 * (i % 3) + 0.1 * (i // 3 % 2), 82.0, 1 + i, 5.0) for i in range(12)] + [("lone", DAY0, DAY0, 24.5, 82.5, 1, None)]
    ev = spark.createDataFrame(rows, "event_id string, start_time timestamp_ntz, end_time timestamp_ntz, latitude double, longitude double, detection_count bigint, frp_peak_mw double")
    out, sites = events.discover_sites(ev, S)
    got = {r.site_id: r for r in sites.collect()}
    assert set(got) == {"S0001", "S0002"} and all(r.event_count == 6 and r.diameter_km < 1.5 and r.active_days == 6 for r in got.values())
    assert out.where("site_id = ''").first().event_id == "lone"


# ---- context


def test_line_beats_a_nearer_centre(spark):
    rows = [(0, "line", "l", "power=line", [[(24.0, 82.0), (24.0, 83.0)]]), (1, "point", "p", "x", [[(24.0, 82.02)]]), (2, "ring", "r", "x", [[(25.0, 82.0), (25.0, 82.1), (25.1, 82.1), (25.1, 82.0), (25.0, 82.0)]])]
    fac = spark.createDataFrame(rows, "fac_ord bigint, facility_id string, name string, kind string, parts array<array<struct<lat: double, lon: double>>>")
    pts = spark.createDataFrame([("a", 24.0, 82.01), ("in", 25.05, 82.05), ("b", 25.2, 82.05)], "event_id string, latitude double, longitude double")
    got = {r.event_id: r for r in context.nearest_facility(pts, fac).collect()}
    assert got["a"].nearest_facility_id == "line" and got["a"].facility_distance_km == pytest.approx(0, abs=1e-9)
    assert got["in"].facility_distance_km == 0 and got["b"].facility_distance_km == pytest.approx(0.1 * 110.57, rel=1e-6)
    none = context.nearest_facility(pts, fac.where("false")).collect()
    assert [(r.facility_distance_km, r.nearest_facility_id) for r in none] == [(None, "")] * 3


def test_nearest_facility_in_blocks(spark, monkeypatch):
    rows = [(i, f"f{i}", "", "", [[(23.0 + i * 0.1, 82.0)]]) for i in range(20)]
    fac = spark.createDataFrame(rows, "fac_ord bigint, facility_id string, name string, kind string, parts array<array<struct<lat: double, lon: double>>>")
    pts = spark.createDataFrame([(i, 23.0 + i * 0.07, 82.01) for i in range(25)], "event_id bigint, latitude double, longitude double")
    want = sorted(context.nearest_facility(pts, fac).collect())
    monkeypatch.setattr(context, "BLOCK_VERTICES", 6)
    assert sorted(context.nearest_facility(pts, fac).collect()) == want


def test_context_golden(spark):
    rows = [(0.4, 1.0, 0.75, 0.1, 0.15), (1.0, 1.0, 0.1, 0.05, 0.05), (None, 1.0, 0.7, 0.0, 0.0), (3.0, 0.5, 0.9, 0.5, 0.5), (None, 0.2, 0.9, 0.5, 0.5), (1.0, 1.0, 0.1, None, 0.5)]
    df = spark.createDataFrame(rows, "facility_distance_km double, worldcover_coverage double, vegetation_fraction double, built_fraction double, bare_fraction double")
    got = [(r.context_label, r.context_conflict) for r in context.assign_context(df, S.context).collect()]
    assert got == [("mixed", True), ("industrial_associated", False), ("vegetation_associated", False), ("mixed", True), ("unknown", False), ("mixed", False)]


# ---- scores


def scored(spark, rows, m=Models(min_calibration_events=4, min_history_events=4)):
    out = scores.robust_z(scores.history(scores.prepared(spark.createDataFrame(rows, EPISODE)), m), m)
    return scores.fused(scores.calibrated(out, m))


def test_constant_history_ranks_in_the_middle_and_future_changes_nothing(spark):
    rows = [episode(f"e{i}", i * 3) for i in range(16)]
    one = {r.event_id: r for r in scored(spark, rows).collect()}
    ranks = {r.anomaly_score for r in one.values() if r.anomaly_score is not None}
    assert ranks == {0.5} and one["e0"].anomaly_score is None and one["e15"].review_priority == "lower"
    more = {r.event_id: r.anomaly_score for r in scored(spark, [*rows, *[episode(f"x{i}", 100 + i, frp=1e6) for i in range(5)]]).collect()}
    assert all(more[i] == r.anomaly_score for i, r in one.items())


def test_growth_ranks_high_and_near_real_time_is_no_history(spark):
    rows = [episode(f"e{i}", i * 3, frp=10.0 + i % 2) for i in range(16)] + [episode("big", 60, frp=500.0)]
    got = {r.event_id: r for r in scored(spark, rows).collect()}
    assert got["big"].anomaly_score > 0.9 and got["big"].history_event_count == 16
    nrt = [episode(f"e{i}", i * 3, quality="near_real_time") for i in range(16)]
    assert {r.history_event_count for r in scored(spark, nrt).collect()} == {0}
    running = [episode("a", 0, hours=200), episode("b", 1)]
    assert {r.history_event_count for r in scored(spark, running).collect()} == {0}


def test_isolation_forest(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(0, 1, (500, 3))
    f = forest.IsolationForest(x, 50, seed=1)
    assert f.score(np.array([[8.0, 8, 8]]))[0] > f.score(np.zeros((1, 3)))[0] + 0.1
    assert (forest.IsolationForest(x, 50, seed=1).score(x) == f.score(x)).all()
    constant = forest.IsolationForest(np.zeros((40, 2)), 10)
    assert len(set(constant.score(np.zeros((5, 2))))) == 1
    m = Models(min_calibration_events=4, min_history_events=4, isolation_min_training_events=5, isolation_trees=10)
    rows = [episode(f"e{i}", i * 3) for i in range(24)]
    base = forest.with_isolation(scored(spark, rows, m), m).collect()
    got = {r.event_id: r.isolation_anomaly_percentile for r in base}
    assert {v for v in got.values() if v is not None} == {0.5}


def peer_rows():
    refs = [episode(f"r{i:02d}", i, site="", lat=24.3 + (i % 6) * 0.06) for i in range(36)]
    return [*refs, episode("TARGET", 59, site="", lat=24.0)]


def peer_run(spark, rows, p=Peers(season_window_days=60)):
    df = spark.createDataFrame(rows, EPISODE).withColumn("anomaly_score", F.lit(None).cast("double"))
    return {r.event_id: r for r in peers.score_peers(df, p, S.area).collect()}


def test_peers_golden(spark):
    t = peer_run(spark, peer_rows())["TARGET"]
    assert (t.peer_status, t.peer_reference_count, t.peer_score, t.score_method) == ("scored", 36, 0.5, "vegetation_peer")
    rows = peer_rows()
    rows[-1] = episode("TARGET", 59, site="", lat=24.0, frp=100.0)
    assert 0.95 < peer_run(spark, rows)["TARGET"].peer_score < 1
    random.Random(1).shuffle(rows)
    again = peer_run(spark, rows)["TARGET"]
    assert again.peer_reference_hash == t.peer_reference_hash


def test_peer_gates(spark):
    assert peer_run(spark, peer_rows()[6:])["TARGET"].peer_status == "insufficient_peers"
    assert peer_run(spark, peer_rows(), Peers(min_days=40, season_window_days=60))["TARGET"].peer_status == "insufficient_peer_days"
    assert peer_run(spark, peer_rows(), Peers(min_cells=20, season_window_days=60))["TARGET"].peer_status == "insufficient_peer_cells"
    out = [*peer_rows()[:-1], episode("TARGET", 59, lat=40.0)]
    assert peer_run(spark, out)["TARGET"].peer_status == "invalid_peer_location_or_time"
    soon = [*peer_rows()[:-1], episode("TARGET", 36, lat=24.0)]
    assert peer_run(spark, soon)["TARGET"].peer_reference_count == 29  # the gap of seven days
    with pytest.raises(ValueError, match="peer"):
        Peers(exclude_radius_km=200)


@pytest.mark.parametrize(
    ("change", "status"),
    [({"anomaly_score": 0.5}, "scored"), ({"anomaly_score": 1.5}, "invalid_score"), ({"peer_status": "insufficient_peers"}, "insufficient_peers"), ({"site_id": " "}, "no_recurrent_site"), ({"history_event_count": 2}, "insufficient_site_history"), ({"model_feature_count": 2}, "insufficient_features"), ({"model_daynight": "unknown"}, "unknown_daynight"), ({"calibration_event_count": 3}, "insufficient_calibration"), ({}, "diagnostics_unavailable")],
)
def test_score_gate(spark, change, status):
    row = {"event_id": "e", "site_id": "S1", "context_label": "vegetation_associated", "nearest_facility_kind": None, "history_event_count": 40, "model_feature_count": 6, "model_daynight": "D", "calibration_event_count": 40, "anomaly_score": None, "peer_status": None, **change}
    schema = "event_id string, site_id string, context_label string, nearest_facility_kind string, history_event_count bigint, model_feature_count bigint, model_daynight string, calibration_event_count bigint, anomaly_score double, peer_status string"
    assert decision.decide(spark.createDataFrame([row], schema), S.models).first().score_status == status


def test_quarries_are_mining(spark):
    rows = [("a", "industrial_associated", "Landuse=Quarry ", 0.97), ("b", "industrial_associated", "power=plant", 0.97), ("c", "industrial_associated", "landuse=quarry", 0.2), ("d", "mixed", "landuse=quarry", 0.99)]
    got = {r.event_id: r.decision for r in decision.decide(spark.createDataFrame(rows, "event_id string, context_label string, nearest_facility_kind string, anomaly_score double"), S.models).collect()}
    assert got == {"a": "suspected_abnormal_mining_associated_event", "b": "suspected_abnormal_industrial_associated_event", "c": "mining_associated_thermal_source", "d": "mixed_or_unknown"}


# ---- imagery


def test_burn_ratio_golden(spark):
    names = ["pre_nir", "pre_swir16", "pre_swir22", "post_nir", "post_swir16", "post_swir22"]
    rows = [(1, *(0.6, 0.2, 0.1, 0.3, 0.25, 0.3), 4, 9 if i == 0 else 4) for i in range(16)]
    df = spark.createDataFrame(rows, "pair bigint, " + ", ".join(f"{n} double" for n in names) + ", pre_scl int, post_scl int")
    r = evidence.change_rule(evidence.pixel_statistics(df, Evidence(), ["pair"]), Evidence()).first()
    assert r.dnbr_mean == pytest.approx(5 / 7) and r.joint_valid_fraction == 15 / 16 and r.evidence == "observed_burn_like_change" and r.affected_area_m2 == 6000
    cloudy = df.withColumn("post_scl", F.lit(9))
    r = evidence.change_rule(evidence.pixel_statistics(cloudy, Evidence(), ["pair"]), Evidence()).first()
    assert (r.status, r.evidence, r.dnbr_mean) == ("cloud_obscured", "inconclusive", None)


def test_legacy_pairs_are_withheld_and_best_is_kept(spark):
    cols = ", ".join(f"{c} double" for c in evidence.METRICS)
    row = lambda e, rank, legacy, status, joint: (e, rank, legacy, status, "no_clear_change", joint, *[1.0] * len(evidence.METRICS))
    rows = [row("a", 1, False, "cloud_obscured", 0.1), row("a", 2, True, "analysed", 0.9), row("b", 1, False, "cloud_obscured", 0.1), row("b", 2, False, "cloud_obscured", 0.3), row("b", 9, False, "analysed", 1.0)]
    df = spark.createDataFrame(rows, f"event_id string, pair_rank int, legacy boolean, status string, evidence string, joint_valid_fraction double, {cols}")
    got = {r.event_id: r for r in evidence.best_attempt(df, Evidence()).collect()}
    assert (got["a"].pair_rank, got["a"].dnbr_mean, got["a"].evidence) == (2, None, "inconclusive") and got["b"].pair_rank == 2


# ---- serving, governance, tuning


def test_filter_rules(spark):
    rows = [("a", 0.0, DAY0, DAY0), ("b", None, None, DAY0), ("c", 0.9, None, None), ("d", 0.2, DAY0 + timedelta(days=9), None)]
    df = spark.createDataFrame(rows, "event_id string, anomaly_score double, start_time timestamp_ntz, end_time timestamp_ntz").withColumn("decision", F.lit("x"))
    ids = lambda f: {r.event_id for r in serving.search(df, f).collect()}
    assert ids(serving.Filter(min_score=0.5)) == {"b", "c"} and ids(serving.Filter(availability="unscored")) == {"b"}
    assert ids(serving.Filter(span=serving.Span("2023-01-01", "2023-01-02"))) == {"a", "b"} and ids(serving.Filter(query="  C ")) == {"c"}
    assert serving.window("custom", "x", "2024-01-02", "2024-01-02") == serving.Span("2024-01-01 18:30:00", "2024-01-02 18:29:59.999000")
    assert serving.clusters_wanted(10, 1201) and not serving.clusters_wanted(11, 5000)


def test_publish_keeps_the_old_result_on_failure(spark, tmp_path):
    target = f"file://{tmp_path}/out"
    good = spark.createDataFrame([("a", 0.5)], "event_id string, anomaly_score double")
    governance.publish(good, target, governance.violations)
    with pytest.raises(ValueError, match="rules"):
        governance.publish(good.union(good), target, governance.violations)
    assert spark.read.parquet(target).count() == 1
    governance.publish(good.withColumn("anomaly_score", F.lit(0.7)), target, governance.violations)
    assert spark.read.parquet(target).first().anomaly_score == 0.7 and len(list(tmp_path.iterdir())) == 1


def test_manifest(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x")
    (tmp_path / "b.txt").write_text("y")
    first = governance.manifest(spark, f"file://{tmp_path}").collect()
    kept = spark.createDataFrame(first)
    assert governance.manifest_errors(kept, governance.manifest(spark, f"file://{tmp_path}")).isEmpty()
    (tmp_path / "b.txt").write_text("z")
    (tmp_path / "c.txt").write_text("z")
    errors = {(r.path.rsplit("/", 1)[1], r.error) for r in governance.manifest_errors(kept, governance.manifest(spark, f"file://{tmp_path}")).collect()}
    assert errors == {("b.txt", "content"), ("c.txt", "unlisted")}


def test_rand_index(spark):
    df = spark.createDataFrame([(i % 3, i % 3 + 5, i % 2) for i in range(30)], "a bigint, b bigint, c bigint")
    assert tuning.adjusted_rand(df, "a", "b").first().ari == pytest.approx(1) and tuning.adjusted_rand(df, "a", "c").first().ari < 0.1


def test_whole_analysis(spark):
    rnd = random.Random(5)
    rows = []
    for site in range(3):
        for n in range(20):
            for k in range(3):
                rows.append((f"d{site}-{n}-{k}", DAY0 + timedelta(days=n * 4, hours=k), 23.5 + site * 0.3 + k * 0.001, 82.0, "VIIRS_SNPP", rnd.uniform(1, 9), 300.0, 10.0, "D", 0.6, None, "science_quality"))
    fac = spark.createDataFrame([(0, "f", "n", "power=plant", [[(23.5, 82.0)]])], "fac_ord bigint, facility_id string, name string, kind string, parts array<array<struct<lat: double, lon: double>>>")
    s = replace(S, models=Models(min_calibration_events=8, isolation_min_training_events=8, isolation_trees=5))
    dets, ev, sites = analysis.run(spark.createDataFrame(rows, DETECTION), fac, s, "2024-01-01 00:00:00")
    assert ev.count() == 60 and sites.count() == 3 and dets.count() == 180
    assert ev.where("anomaly_score between 0 and 1").count() > 10 and ev.where("decision is null").count() == 0


def test_ring_with_a_gap_is_closed_for_what_is_inside(spark):
    """The gap lies in the side that the ray from the middle meets."""
    e = 0.005
    ring = [(24.0 + 0.00006, 82.0 + e), (24.0 + e, 82.0 + e), (24.0 + e, 82.0 - e), (24.0 - e, 82.0 - e), (24.0 - e, 82.0 + e), (24.0 - 0.00006, 82.0 + e)]
    f = spark.createDataFrame([(1, "f", "n", "k", [ring])], "fac_ord int, facility_id string, name string, kind string, parts array<array<struct<lat: double, lon: double>>>")
    p = spark.createDataFrame([(1, 24.0, 82.0), (2, 24.0, 82.0 + 2 * e)], "event_id int, latitude double, longitude double")
    got = {r.event_id: r.facility_distance_km for r in context.nearest_facility(p, f).collect()}
    assert got[1] == 0.0 and 0.4 < got[2] < 0.6


def test_sites_link_places_by_their_events(spark):
    """Events at one place are linked as one place with their number: the same sites as those of all events."""
    import numpy as np
    from emberflow.operators import clustering

    rng = np.random.default_rng(5)
    at = rng.integers(0, 40, (400, 2))
    rows = [(i, 24 + float(a) / 400, 82 + float(b) / 400) for i, (a, b) in enumerate(at.tolist())]
    events = spark.createDataFrame(rows, "event_id int, latitude double, longitude double")
    got = {r.key: (r.component, r.part) for r in clustering.site_members(events, 1.5, 3).where("part >= 0").collect()}
    groups = {}
    for k, v in got.items():
        groups.setdefault(v, []).append(k)
    place = {i: (a, b) for i, a, b in rows}
    assert groups and all(len(g) >= 3 for g in groups.values())
    assert len({(place[k], v) for k, v in got.items()}) == len({place[k] for k in got})  # a place is in one site
    km = lambda p, q: np.hypot((p[0] - q[0]) * 110.6, (p[1] - q[1]) * 111.4 * np.cos(np.radians(24)))
    assert max(km(place[a], place[b]) for g in groups.values() for a in g for b in g) < 1.52
