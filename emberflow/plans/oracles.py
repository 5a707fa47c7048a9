"""The registered queries once more, in SQL for an independent engine, written apart from the DataFrame operators.

Only the views over the test tables are shared.
"""

from __future__ import annotations

from emberflow.sources.views import sql_of


def _w(views: str, body: str, *more: str) -> str:
    own = [f"{v} as ({sql_of(v)})" for v in views.split()]
    return "with " + ",\n".join([*own, *more]) + "\n" + body


def _hav(a: str, b: str, c: str, d: str) -> str:
    return f"(2*6371.0088e0*asin(sqrt(least(greatest(power(sin(radians({c}-({a}))/2),2)+cos(radians({a}))*cos(radians({c}))*power(sin(radians({d}-({b}))/2),2),0),1))))"


# ---- pieces

_TIME = """parsed as (select *, case when regexp_matches(t4, '^[0-9]{4}$') then try_cast(acq_date || ' ' || substr(t4,1,2) || ':' || substr(t4,3,2) || ':00' as timestamp) end as acquired_at
from (select *, case when length(t) >= 4 then t else lpad(t, 4, '0') end as t4 from (select *, regexp_replace(acq_time, '\\.0$', '') as t from raw_detections) x) y)"""
_SENSOR = """case when instrument='VIIRS' and p in ('N','SNPP','SUOMINPP') then 'VIIRS_SNPP' when instrument='VIIRS' and p in ('N20','NOAA20','J1','JPSS1') then 'VIIRS_NOAA20'
 when instrument='VIIRS' and p in ('N21','NOAA21','J2','JPSS2') then 'VIIRS_NOAA21' when instrument='MODIS' and p='TERRA' then 'MODIS_TERRA' when instrument='MODIS' and p='AQUA' then 'MODIS_AQUA' else 'UNSUPPORTED' end"""
_JUDGED = f"""judged as (select *, coalesce(lat between -90 and 90 and lon between -180 and 180, false) as coordinates_ok, coalesce(acquired_at <= timestamp '2024-01-25 00:00:00', false) as time_ok,
 coalesce(lat between 23.2 and 25.2 and lon between 81.5 and 83.5, false) as in_area, sensor in ('VIIRS_SNPP','VIIRS_NOAA20') as accepted, sensor <> 'UNSUPPORTED' as supported
 from (select *, try_cast(latitude as double) as lat, try_cast(longitude as double) as lon, {_SENSOR} as sensor from (select *, regexp_replace(upper(satellite), '[^A-Z0-9]', '', 'g') as p from parsed) a) b)"""
_GOOD = """good as (select *, case when version ilike '%nrt%' then 'near_real_time' when try_cast(version as double) is not null then 'science_quality' else 'unknown' end as data_quality
 from judged where coordinates_ok and time_ok and in_area and accepted and supported)"""
_RAW = (_TIME, _JUDGED, _GOOD)
_CL = """c as (select *, floor(latitude*10)::bigint || ':' || floor(longitude*10)::bigint || ':' || strftime(acquired_at, '%Y-%m-%d') as cluster,
 case when upper(daynight) in ('D','N') then upper(daynight) else 'unknown' end as phase from detections)"""
_SNAP = "s as (select cluster, sensor, phase, acquired_at, sum(frp) as fs, count(frp) as fv, count(*) as ds, max(brightness) as br, max(brightness_temperature_difference) as btd from c group by all)"
_PRI = "case sensor when 'VIIRS_SNPP' then 0 when 'VIIRS_NOAA20' then 1 when 'VIIRS_NOAA21' then 2 when 'MODIS_TERRA' then 3 when 'MODIS_AQUA' then 4 else 9 end"
_PTS = """pts as (select event_id as k, (longitude-lon0)*111.32e0*cos(radians(lat0))/2.0e0 as x, (latitude-lat0)*110.57e0/2.0e0 as y, epoch(acquired_at - t0)/86400.0e0 as t
 from detections, (select avg(latitude) as lat0, avg(longitude) as lon0, min(acquired_at) as t0 from detections) o)"""
_PAIRS = "pairs as (select a.k as a, b.k as b from pts a join pts b on a.k < b.k and abs(a.t-b.t) <= 1 and power(a.x-b.x,2)+power(a.y-b.y,2)+power(a.t-b.t,2) <= 1)"
_REACH = """reach as (with recursive ways as (select a, b from pairs union all select b, a from pairs), r as (select k, k as root from pts union select e.b, r.root from r join ways e on e.a = r.k where r.root < e.b) select * from r)"""
_HIST = """h as (select c.event_id, c.start_time, p.* exclude (event_id, start_time, end_time), p.start_time as hs, p.end_time as he,
 least(abs(dayofyear(p.start_time)-dayofyear(c.start_time)), 366-abs(dayofyear(p.start_time)-dayofyear(c.start_time))) <= 45 as season
 from episodes c join episodes p on c.site_id=p.site_id and c.model_sensor=p.model_sensor and c.model_daynight=p.model_daynight
 where c.site_id<>'' and p.data_quality='science_quality' and p.end_time < c.start_time and p.start_time >= c.start_time - interval 2557 days)"""
_USED = """g as (select event_id, count(*) as n, count_if(season)::bigint as ns from h group by 1),
used as (select h.* from h join g using (event_id) where g.n >= 6 and (g.ns < 12 or h.season))"""
_FEATURES = ("frp_peak_mw", "frp_median_mw", "detection_peak", "duration_hours", "spread_km", "brightness_temperature_difference_max")


def _z() -> str:
    parts = []
    for f in _FEATURES:
        parts.append(
            f"z_{f} as (select e.event_id, case when m.n >= 3 then (e.{f}-m.med)/(case when 1.4826e0*d.mad >= 1e-9 then 1.4826e0*d.mad else greatest(m.sd, abs(m.med)*0.05e0, 1e-6) end) end as z from episodes e"
            f" join (select event_id, count({f}) as n, median({f}) as med, stddev_pop({f}) as sd from used group by 1) m using (event_id)"
            f" join (select u.event_id, median(abs(u.{f}-m.med)) as mad from used u join (select event_id, median({f}) as med from used group by 1) m using (event_id) group by 1) d using (event_id))"
        )
    return ",\n".join(parts)


_SCORED_GATE = """gate as (select *, case when anomaly_score is not null then 'scored'
 when context_label='vegetation_associated' and peer_status is not null and peer_status not in ('not_applicable','scored') then peer_status
 when trim(coalesce(site_id,''))='' then 'no_recurrent_site' when history_event_count < 6 then 'insufficient_site_history' when model_feature_count < 3 then 'insufficient_features'
 when model_daynight='unknown' then 'unknown_daynight' when calibration_event_count < 32 then 'insufficient_calibration' else 'diagnostics_unavailable' end as score_status,
 case when context_label='industrial_associated' and lower(trim(coalesce(nearest_facility_kind,'')))='landuse=quarry' then 'mining_quarry' else context_label end as source_context from scored),
decided as (select *, case when source_context='mining_quarry' then case when score_status<>'scored' then 'mining_associated_unscored' when anomaly_score>=0.95 then 'suspected_abnormal_mining_associated_event' else 'mining_associated_thermal_source' end
 when context_label='industrial_associated' then case when score_status<>'scored' then 'industrial_associated_unscored' when anomaly_score>=0.95 then 'suspected_abnormal_industrial_associated_event' else 'routine_persistent_industrial_thermal_source' end
 when context_label='vegetation_associated' then 'likely_vegetation_fire' else 'mixed_or_unknown' end as decision from gate)"""


def _peer(source: str, cap: int = 2000) -> tuple[str, ...]:
    return (
        f"""pe as (select *, floor((longitude-81.5e0)*111.32e0*cos(radians((23.2e0+25.2e0)/2))/5.0e0)::bigint || ':' || floor((latitude-23.2e0)*110.57e0/5.0e0)::bigint as cell, cast(start_time as date) as day,
 latitude between 23.2 and 25.2 and longitude between 81.5 and 83.5 and end_time >= start_time as place_ok, worldcover_dominant in ('tree_cover','cropland','shrubland','grassland') and worldcover_coverage >= 0.8 as cover_ok,
 model_daynight in ('D','N') as kind_ok, case when frp_peak_mw > 0 then frp_peak_mw end as v1, brightness_temperature_difference_max as v2, case when detection_peak >= 1 then detection_peak end as v3 from ({source}) q0)""",
        "pj as (select *, context_label='vegetation_associated' and anomaly_score is null as target, context_label='vegetation_associated' and place_ok and cover_ok and kind_ok and v1 is not null and v2 is not null and v3 is not null and data_quality='science_quality' as eligible from pe)",
        f"""met as (select t.event_id as target_id, r.event_id, r.day, r.cell, r.v1, r.v2, r.v3, row_number() over (partition by t.event_id, r.cell, r.day order by cast(r.event_id as varchar)) as k
 from pj t join pj r on t.worldcover_dominant=r.worldcover_dominant and t.model_sensor=r.model_sensor and t.model_daynight=r.model_daynight
 where t.target and t.place_ok and t.cover_ok and t.kind_ok and r.eligible and r.end_time < t.day - interval 7 days and r.start_time >= t.start_time - interval 2557 days
 and least(abs(dayofyear(r.start_time)-dayofyear(t.start_time)), 366-abs(dayofyear(r.start_time)-dayofyear(t.start_time))) <= 45
 and {_hav("t.latitude", "t.longitude", "r.latitude", "r.longitude")} <= 100 and {_hav("t.latitude", "t.longitude", "r.latitude", "r.longitude")} > 2)""",
        f"refs as (select * from (select *, row_number() over (partition by target_id order by day desc, cast(event_id as varchar) desc) as late from met where k = 1) z where late <= {cap})",
    )


_PEERS = "select *, case when event_id % 5 = 0 then 0.4e0 end as anomaly_score from episodes"
_SCENES = """sc as (select 's-' || fac_ord || '-' || step as scene_id, case when fac_ord%3=0 then 'sentinel-2-l2a' else 'sentinel-2-c1-l2a' end as collection, 't' || (fac_ord%4) as tile,
 timestamp '1994-12-01 10:00:00' + cast(step*14+fac_ord%13 as integer) * interval 1 day as shot, ((fac_ord*13+step*7)%100)::double as cloud, case when fac_ord%5=0 then 'nir08' else 'nir' end as nir, 22.0+fac_ord%2 as south, 24.5+fac_ord%2 as north from facilities, range(183) r(step)),
ev as (select * from episodes where end_time < timestamp '2001-10-01'),
sided as (select ev.event_id, sc.collection, sc.tile, sc.nir, sc.scene_id, sc.shot, sc.cloud, case when sc.shot < ev.start_time then 'pre' else 'post' end as side,
 case when sc.shot < ev.start_time then epoch(ev.start_time - sc.shot) else epoch(sc.shot - ev.end_time) end as lag from ev, sc
 where ev.latitude between sc.south and sc.north and ev.longitude between 81 and 84 and sc.cloud <= 70 and sc.shot <= timestamp '2001-10-01'
 and ((sc.shot < ev.start_time and sc.shot >= ev.start_time - interval 45 days) or (sc.shot > ev.end_time and sc.shot <= ev.end_time + interval 30 days))),
one as (select * from sided qualify row_number() over (partition by event_id, collection, tile, side, shot order by scene_id) = 1),
kept as (select * from one qualify row_number() over (partition by event_id, collection, tile, side order by lag, cloud, scene_id) <= 12)"""
_PIX = """px as (select p_size::bigint as pair, (p_partkey%50)/100.0e0+0.2e0 as n0, (p_partkey%30)/100.0e0+0.1e0 as s0, (p_partkey%20)/100.0e0+0.05e0 as t0, (p_partkey%40)/100.0e0+p_size/200.0e0 as n1, (p_partkey%30)/100.0e0+0.15e0 as s1,
 (p_partkey%25)/100.0e0+p_size/300.0e0 as t1, [4,5,6,4,5,9,4,3][p_partkey%8+1] as c0, [4,5,6,4,5,9,4,3][(p_partkey+p_size)%8+1] as c1 from part),
ix as (select *, c0 in (4,5,6) as ok0, c1 in (4,5,6) as ok1, (n0-t0)/(n0+t0)-(n1-t1)/(n1+t1) as d from px),
st as (select pair, count(*) as pixels, count_if(ok0 and ok1)::bigint as valid_pixels, count_if(ok0 and ok1)/count(*)::double as joint_valid_fraction,
 avg(d) filter (ok0 and ok1) as dnbr_mean, median(d) filter (ok0 and ok1) as dnbr_median, avg((d >= 0.1)::int) filter (ok0 and ok1) as affected_fraction, (count_if(ok0 and ok1 and d >= 0.1)*400)::bigint as affected_area_m2,
 (avg(t1) filter (ok0 and ok1) - avg(t0) filter (ok0 and ok1))/greatest(abs(avg(t0) filter (ok0 and ok1)), 1e-6) as swir12_relative_change,
 avg((t1-s1)/(t1+s1)) filter (ok0 and ok1) - avg((t0-s0)/(t0+s0)) filter (ok0 and ok1) as normalized_swir_change,
 avg((abs((t1-t0)/greatest(t0,0.02)) >= 0.2)::int) filter (ok0 and ok1) as swir_affected_fraction, avg((c0 in (3,8,9,10))::int) as pre_cloud_fraction from ix group by 1)"""
_CTX = """x as (select event_id, worldcover_coverage as cov, case when event_id%9=0 then null else (event_id%70)/10.0e0 end as dist, case when event_id%8=0 then null else (event_id%11)/10.0e0 end as veg,
 case when event_id%10=0 then null else (event_id%3)/20.0e0 end as built, (event_id%4)/40.0e0 as bare from episodes),
y as (select *, case when cov >= 0.8 then veg end as v, case when cov >= 0.8 then built+bare else 0 end as dev from x),
z as (select *, case when dist <= 5 and v >= 0.6 then 'mixed' when dist <= 2 and dev >= 0.1 then 'industrial_associated' when v >= 0.6 and (dist is null or dist > 5) then 'vegetation_associated'
 when dist <= 5 or v >= 0.4 then 'mixed' else 'unknown' end as context_label from y)"""
_VERS = """old as (select * from decided where event_id%50<>9), new as (select * exclude (anomaly_score, site_id), case when event_id%40=3 then anomaly_score+0.001e0 else anomaly_score end as anomaly_score, case when event_id%60=1 then 'moved' else site_id end as site_id from decided where event_id%50<>7),
j as (select o.event_id as a, n.event_id as b, o.anomaly_score as sa, n.anomaly_score as sb, o.site_id as ia, n.site_id as ib, o.decision as da, n.decision as db, o.source_context as ca, n.source_context as cb from old o full join new n on o.event_id=n.event_id)"""
_RUNS = "runs as (select (p_size%9)::bigint as trial, p_retailprice%100/100 as ari from part)"


def _segments(ring: bool) -> str:
    if not ring:
        return "sg as (select fac_ord, facility_id, lat0 as a1, lon0 as o1, lat0 as a2, lon0 as o2 from facilities)"
    c = [(-1, -1), (-1, 1), (1, 1), (1, -1), (-1, -1)]
    rows = " union all ".join(f"select fac_ord, facility_id, lat0+({c[i][0]})*half as a1, lon0+({c[i][1]})*half as o1, lat0+({c[i + 1][0]})*half as a2, lon0+({c[i + 1][1]})*half as o2 from facilities" for i in range(4))
    return f"sg as ({rows})"


def _nearest(ring: bool) -> str:
    k = "111.32e0*cos(radians(latitude))"
    return _w(
        "detections facilities",
        "select event_id, round(min(d),6) as distance_km, arg_min(facility_id, (d, fac_ord)) as facility_id from fd group by event_id",
        _segments(ring),
        f"w as (select event_id, fac_ord, facility_id, (o1-longitude)*{k} as x1, (a1-latitude)*110.57e0 as y1, (o2-longitude)*{k} as x2, (a2-latitude)*110.57e0 as y2 from detections, sg)",
        "u as (select *, case when power(x2-x1,2)+power(y2-y1,2) > 0 then least(greatest(-(x1*(x2-x1)+y1*(y2-y1))/(power(x2-x1,2)+power(y2-y1,2)),0),1) else 0 end as t, case when (y1>0)<>(y2>0) and x1+(x2-x1)*(-y1)/(y2-y1) > 0 then 1 else 0 end as cr from w)",
        "fd as (select event_id, fac_ord, facility_id, case when sum(cr)%2=1 then 0 else min(sqrt(power(x1+t*(x2-x1),2)+power(y1+t*(y2-y1),2))) end as d from u group by all)",
    )


SQL: dict[str, str] = {
    "ingest_try_numeric": _w("raw_detections", "select row_no, try_cast(latitude as double) as latitude, try_cast(bright_t31 as double) as bright_t31 from raw_detections"),
    "ingest_coord_valid": _w("raw_detections", "select row_no, coalesce(abs(try_cast(latitude as double)) <= 90 and abs(try_cast(longitude as double)) <= 180, false) as valid from raw_detections"),
    "ingest_hhmm_timestamp": _w("raw_detections", "select row_no, acquired_at, time_ok from judged", *_RAW[:2]),
    "ingest_aoi_filter": _w("detections", "select event_id, round(latitude,6) as latitude, round(longitude,6) as longitude from detections where not (latitude < 23.2 or latitude > 25.2 or longitude < 81.5 or longitude > 83.5)"),
    "ingest_sensor_case": _w("raw_detections", "select row_no, sensor, supported, accepted from judged", *_RAW[:2]),
    "ingest_accept_counts": _w("raw_detections", "select sensor, sum(accepted::int)::bigint as accepted_rows, sum((not accepted)::int)::bigint as excluded_rows from judged group by sensor", *_RAW[:2]),
    "ingest_band_coalesce": _w("raw_detections", "select row_no, try_cast(case when sensor like 'VIIRS%' then bright_ti4 else brightness end as double) as brightness, try_cast(case when sensor like 'VIIRS%' then bright_ti4 else brightness end as double) - try_cast(case when sensor like 'VIIRS%' then bright_ti5 else bright_t31 end as double) as difference from judged", *_RAW[:2]),
    "ingest_positive_finite": _w("raw_detections", "select row_no, case when frp > 0 then frp end as frp from raw_detections"),
    "ingest_confidence": _w("raw_detections", "select row_no, coalesce(case lower(trim(confidence)) when 'l' then 0.2e0 when 'low' then 0.2e0 when 'n' then 0.6e0 when 'nominal' then 0.6e0 when 'h' then 1e0 when 'high' then 1e0 end, case when try_cast(confidence as double) is not null then least(greatest(try_cast(confidence as double),0),100)/100 end) as score from raw_detections"),
    "ingest_quality": _w("raw_detections", "select row_no, case when position('NRT' in upper(version)) > 0 then 'near_real_time' when try_cast(version as double) is null then 'unknown' else 'science_quality' end as quality from raw_detections"),
    "ingest_dedup_priority": _w("raw_detections", "select sensor, lat as latitude, lon as longitude, acquired_at, data_quality, source_file from good qualify row_number() over (partition by sensor, lat, lon, acquired_at order by case data_quality when 'science_quality' then 0 when 'near_real_time' then 1 else 2 end, source_file desc, version desc, case when frp > 0 then frp end desc nulls last) = 1", *_RAW),
    "ingest_detection_id": _w("raw_detections", "select row_no, 'D' || substr(sha1(sensor || '|' || lat::varchar || '|' || lon::varchar || '|' || strftime(acquired_at, '%Y-%m-%dT%H:%M:%S') || '+00:00'),1,16) as detection_id from judged where coordinates_ok and time_ok", *_RAW[:2]),
    "audit_file_counters": _w("raw_detections", """select source_file, count(*) as raw_rows, count(*) filter (not coordinates_ok) as invalid_coordinate_rows, count(*) filter (not time_ok) as invalid_or_future_time_rows,
 count(*) filter (ok and not supported) as unsupported_sensor_rows, count(*) filter (ok and supported and not accepted) as excluded_sensor_rows, count(*) filter (ok and accepted) as aoi_valid_rows,
 min(acquired_at) filter (time_ok) as source_earliest, max(acquired_at) filter (time_ok) as source_latest from (select *, coordinates_ok and time_ok and in_area as ok from judged) x group by source_file""", *_RAW[:2]),
    "audit_year_sensor_quality": _w("raw_detections", "select year(acquired_at)::int as year, sensor, data_quality, count(*) as detections from good group by all", *_RAW),
    "audit_missing_sensor_years": _w("raw_detections", "select y::int as year, s as sensor from (values (2023),(2024),(2025)) a(y), (values ('VIIRS_SNPP'),('VIIRS_NOAA20')) b(s) where not exists (select 1 from good where data_quality='science_quality' and year(acquired_at)=y and sensor=s)", *_RAW),
    "audit_missing_years": _w("raw_detections", "select y::int as year from (values (2023),(2024),(2025)) a(y) where y not in (select year(acquired_at) from good where data_quality='science_quality')", *_RAW),
    "union_chunks": _w("detections", "select sensor, count(*) as n, count(case when sensor<>'MODIS_TERRA' then frp end) as with_frp from detections group by sensor"),
    "planar_project": _w("detections", "select k as event_id, round(x,6) as x, round(y,6) as y, round(t,6) as t from pts", _PTS),
    "snapshot_agg": _w("detections", "select cluster, sensor, phase, acquired_at, round(fs,6) as frp_snapshot, fv as frp_valid, ds as detection_snapshot from s", _CL, _SNAP),
    "snapshot_two_level": _w("detections", "select cluster, count(*) as observation_count, round(max(fs),6) as frp_peak_mw, round(median(fs),6) as frp_median_mw, max(ds) as detection_peak from s group by cluster", _CL, _SNAP),
    "representative_stratum": _w("detections", f"""select s.cluster, r.sensor as model_sensor, r.phase as model_daynight, round(max(fs),6) as frp_peak_mw, round(median(fs),6) as frp_median_mw, max(ds) as detection_peak, max(br) as brightness_max
 from s join (select distinct on (cluster) cluster, sensor, phase from s order by cluster, phase='unknown', {_PRI}, case phase when 'N' then 0 when 'D' then 1 else 2 end) r on s.cluster=r.cluster and s.sensor=r.sensor and s.phase=r.phase group by 1,2,3""", _CL, _SNAP),
    "family_pivot": _w("detections", "select cluster, round(max(fs) filter (sensor like 'VIIRS%'),6) as viirs_frp_peak_mw, round(max(fs) filter (sensor not like 'VIIRS%'),6) as modis_frp_peak_mw from s group by cluster", _CL, _SNAP),
    "event_rollup": _w("detections", """select cluster, min(acquired_at) as start_time, max(acquired_at) as end_time, round(avg(latitude),6) as latitude, round(avg(longitude),6) as longitude, count(*) as detection_count, count(*) filter (sensor like 'VIIRS%') as viirs_count,
 count(*) filter (sensor like 'MODIS%') as modis_count, round(avg(case phase when 'N' then 1 when 'D' then 0 end),6) as night_fraction, round(avg(confidence_score),6) as confidence_mean, round(avg(case when firms_type_reference is not null then (firms_type_reference=2)::int end),6) as type_2_fraction from c group by cluster""", _CL),
    "sorted_distinct_set": _w("detections", "select cluster, string_agg(distinct sensor, '|' order by sensor) as sensors, string_agg(distinct phase, '|' order by phase) as phases from c group by cluster", _CL),
    "event_content_id": _w("detections", "select cluster, 'E' || substr(sha1(string_agg(detection_id, '|' order by detection_id)),1,16) as event_id from c group by cluster", _CL),
    "event_spread": _w("detections", f"select cluster, round(max({_hav('latitude', 'longitude', 'cla', 'clo')}),6) as spread_km from c join (select cluster, avg(latitude) as cla, avg(longitude) as clo from c group by cluster) m using (cluster) group by cluster", _CL),
    "episode_split": _w("detections", """select event_id, user_id, episode::bigint as episode from walk""",
     """o as (select event_id, user_id, acquired_at as t, row_number() over (partition by user_id order by acquired_at, event_id) as n from detections)""",
     """walk as (with recursive r as (select event_id, user_id, t, n, t as st, 0 as episode from o where n=1 union all
 select o.event_id, o.user_id, o.t, o.n, case when epoch(o.t-r.st) > 86400 then o.t else r.st end, r.episode + (epoch(o.t-r.st) > 86400)::int from r join o on o.user_id=r.user_id and o.n=r.n+1) select * from r)"""),
    "eps_neighbors": _w("detections", "select a, b from pairs", _PTS, _PAIRS),
    "components": _w("detections", "select k as event_id, min(root) as component from reach group by k", _PTS, _PAIRS, _REACH),
    "cluster_events": _w("detections", f"""select q.event_id, start_time, end_time, detection_count, m.sensor as model_sensor, m.phase as model_daynight, round(m.peak,6) as frp_peak_mw, round(w.far,6) as spread_km
 from (select cluster, 'E' || substr(sha1(string_agg(detection_id, '|' order by detection_id)),1,16) as event_id, min(acquired_at) as start_time, max(acquired_at) as end_time, count(*) as detection_count from c group by 1) q
 join (select s.cluster, r.sensor, r.phase, max(fs) as peak from s join (select distinct on (cluster) cluster, sensor, phase from s order by cluster, phase='unknown', {_PRI}, case phase when 'N' then 0 else 1 end) r on s.cluster=r.cluster and s.sensor=r.sensor and s.phase=r.phase group by 1,2,3) m using (cluster)
 join (select cluster, max({_hav('latitude', 'longitude', 'cla', 'clo')}) as far from c join (select cluster, avg(latitude) as cla, avg(longitude) as clo from c group by 1) z using (cluster) group by 1) w using (cluster)""",
     _PTS, _PAIRS, _REACH, "cl as (select k, min(root) as comp from reach group by k)", "o as (select d.*, comp, row_number() over (partition by comp order by acquired_at, d.event_id) as n from detections d join cl on d.event_id=cl.k)",
     "walk as (with recursive r as (select event_id, comp, n, acquired_at as st, 0 as episode from o where n=1 union all select o.event_id, o.comp, o.n, case when o.acquired_at-r.st > interval 24 hours then o.acquired_at else r.st end, r.episode + (o.acquired_at-r.st > interval 24 hours)::int from r join o on o.comp=r.comp and o.n=r.n+1) select * from r)",
     "c as (select d.*, w.comp || ':' || w.episode as cluster, d.daynight as phase from detections d join walk w using (event_id))", _SNAP),
    "nearest_facility_point": _nearest(False),
    "nearest_facility_polygon": _nearest(True),
    "landcover_fractions": _w("detections landcover", """select p.event_id, d.name as worldcover_dominant, round(least(coalesce(a.n,0)/13.0,1),6) as worldcover_coverage, round(a.veg,6) as vegetation_fraction, round(a.built,6) as built_fraction, round(a.bare,6) as bare_fraction from p
 left join (select event_id, count(*) as n, avg((code in (10,20,30,40,90,95,100))::int) as veg, avg((code=50)::int) as built, avg((code=60)::int) as bare from m group by 1) a using (event_id)
 left join (select distinct on (event_id) event_id, case code when 10 then 'tree_cover' when 30 then 'grassland' when 40 then 'cropland' when 50 then 'built_up' when 60 then 'bare_sparse' when 80 then 'water' end as name from (select event_id, code, count(*) as n, min((px_row, px_col)) as f from m group by 1,2) q order by event_id, n desc, f) d using (event_id)""",
     "p as (select event_id, event_id%20 as r, user_id%100 as c from detections)", "m as (select event_id, code, px_row, px_col from p join landcover on abs(px_row-r) <= 2 and abs(px_col-c) <= 2 and power(px_row-r,2)+power(px_col-c,2) <= 4)"),
    "tile_code": _w("detections", "select event_id, (case when y >= 0 then 'N' else 'S' end) || lpad(abs(y)::varchar,2,'0') || (case when x >= 0 then 'E' else 'W' end) || lpad(abs(x)::varchar,3,'0') as tile from (select event_id, (floor((latitude*3-80)/3)*3)::bigint as y, (floor((longitude*4-340)/3)*3)::bigint as x from detections) q"),
    "assign_context": _w("episodes", "select event_id, context_label, coalesce(context_label='mixed' and dist <= 5 and veg >= 0.6, false) as context_conflict from z", _CTX),
    "source_subtype": _w("scored", "select event_id, source_context from decided", _SCORED_GATE),
    "site_rollup": _w("episodes", f"""select s.*, round(d,6) as diameter_km from (select site_id, round(sum(latitude*detection_count)/sum(detection_count),6) as latitude, round(sum(longitude*detection_count)/sum(detection_count),6) as longitude, count(*) as event_count, count(distinct start_time::date) as active_days,
 min(start_time) as first_seen, max(end_time) as last_seen, sum(detection_count)::bigint as total_detections, round(max(frp_peak_mw),6) as frp_peak_mw_max, round(median(frp_peak_mw),6) as frp_peak_mw_median from episodes where site_id<>'' group by 1) s
 join (select a.site_id, max({_hav("a.latitude", "a.longitude", "b.latitude", "b.longitude")}) as d from u a join u b on a.site_id=b.site_id group by 1) e using (site_id)""", "u as (select distinct site_id, latitude, longitude from episodes)"),
    "history_join": _w("episodes", "select event_id, count(*) as n, max(hs) as previous, min(hs) as first, max(he) as last_end from h group by event_id", _HIST),
    "seasonal_history": _w("episodes", """select e.event_id, coalesce(case when g.n >= 6 and g.ns >= 12 then g.ns else g.n end,0) as history_event_count, case when coalesce(g.n,0) < 6 then 'insufficient_history' when g.ns >= 12 then 'seasonal_same_sensor_and_daynight' else 'rolling_same_sensor_and_daynight' end as baseline_mode,
 u.b0 as baseline_start, u.b1 as baseline_end, round(epoch(e.start_time-p.prev)/86400,6) as days_since_previous from episodes e left join g using (event_id) left join (select event_id, min(hs) as b0, max(he) as b1 from used group by 1) u using (event_id) left join (select event_id, max(hs) as prev from h group by 1) p using (event_id)""", _HIST, _USED),
    "robust_scale": _w("episodes", "select site_id, round(m,6) as median, round(case when 1.4826e0*mad >= 1e-9 then 1.4826e0*mad else greatest(sd, abs(m)*0.05e0, 1e-6) end,6) as scale from (select site_id, median(frp_peak_mw) as m, stddev_pop(frp_peak_mw) as sd from episodes group by 1) a join (select e.site_id, median(abs(frp_peak_mw-m)) as mad from episodes e join (select site_id, median(frp_peak_mw) as m from episodes group by 1) b on e.site_id=b.site_id group by 1) c using (site_id)"),
    "robust_rms": _w("episodes", "select event_id, n::bigint as features, round(z1,6) as z_frp, round(case when n >= 3 then sqrt(q/n) end,6) as raw from (select e.event_id, a.z as z1, "
     + "+".join(f"coalesce((z_{f}.z is not null)::int,0)" for f in _FEATURES) + " as n, " + "+".join(f"coalesce(power(greatest(z_{f}.z,0),2),0)" for f in _FEATURES)
     + " as q from episodes e left join z_frp_peak_mw a using (event_id) " + " ".join(f"left join z_{f} on z_{f}.event_id=e.event_id" for f in _FEATURES) + ") w", _HIST, _USED, _z()),
    "calibrated_midrank": _w("episodes", """select e.event_id, coalesce(q.n,0) as n, round(case when q.n >= 32 then (lt+le+1)/(2.0*(q.n+1)) end,6) as percentile from r e left join
 (select t.event_id, count(*) as n, count_if(f.raw < t.raw) as lt, count_if(f.raw <= t.raw) as le from r t join r f on t.model_sensor=f.model_sensor and t.model_daynight=f.model_daynight and f.end_time < t.day and f.start_time >= t.day - interval 2557 days
 where t.raw is not null and t.model_daynight<>'unknown' and f.raw is not null and f.data_quality='science_quality' group by 1) q using (event_id)""", "r as (select *, case when event_id%12=0 then null else ((event_id*7919)%400)/64.0e0 end as raw, date_trunc('day', start_time) as day from episodes)"),
    "score_fusion": _w("scored", "select event_id, round(case when event_id%3=0 then case when anomaly_score is null then 0.5e0 else (anomaly_score+0.5e0)/2 end else anomaly_score end,6) as score from scored"),
    "priority_band": _w("scored", "select event_id, case when anomaly_score is null then 'unscored' when anomaly_score < 0.8 then 'lower' when anomaly_score < 0.95 then 'moderate' when anomaly_score < 0.99 then 'high' else 'very_high' end as band from scored"),
    "peer_eligibility": _w("episodes", "select event_id, target, eligible, cell from pj", *_peer("select *, null::double as anomaly_score from episodes")[:2]),
    "peer_join": _w("episodes", "select target_id, count(*) as n, count(distinct day) as days, count(distinct cell) as cells, min(event_id) as lowest from refs group by 1", *_peer(_PEERS)),
    "peer_dedup_cap": _w("episodes", "select target_id, count(*) as n, min(day)::varchar as first_day, sum(event_id)::bigint as ids from refs group by 1", *_peer(_PEERS, 40)),
    "peer_score": _w("episodes", """select j.event_id, case when not target then 'not_applicable' when not place_ok then 'invalid_peer_location_or_time' when not cover_ok then 'unknown_peer_landcover' when not kind_ok then 'unknown_peer_sensor_or_phase'
 when coalesce(n,0) < 32 then 'insufficient_peers' when days < 8 then 'insufficient_peer_days' when cells < 3 then 'insufficient_peer_cells' when v1 is null or v2 is null or v3 is null then 'insufficient_peer_features' else 'scored' end as peer_status,
 coalesce(n,0) as n, round(sc,6) as peer_score, round(case when target then sc else anomaly_score end,6) as anomaly_score, case when anomaly_score is not null then 'site_history' when sc is not null then 'vegetation_peer' else 'unavailable' end as score_method
 from pj j left join (select target_id, count(*) as n, count(distinct day) as days, count(distinct cell) as cells from refs group by 1) c on j.event_id=c.target_id left join rk on rk.target_id=j.event_id""", *_peer(_PEERS),
     "md as (select target_id, median(v1) as m1, median(v2) as m2, median(v3) as m3, stddev_pop(v1) as d1, stddev_pop(v2) as d2, stddev_pop(v3) as d3, count(*) as n, count(distinct day) as days, count(distinct cell) as cells from refs group by 1)",
     "ma as (select target_id, " + ", ".join(f"1.4826e0*median(abs(v{k}-m{k})) as a{k}" for k in (1, 2, 3)) + " from refs join md using (target_id) group by 1)",
     "sl as (select md.*, " + ", ".join(f"case when a{k} >= 1e-9 then a{k} else greatest(d{k}, abs(m{k})*0.05e0, 1e-6) end as s{k}" for k in (1, 2, 3)) + " from md join ma using (target_id))",
     "rr as (select target_id, sqrt((" + "+".join(f"power(greatest((v{k}-m{k})/s{k},0),2)" for k in (1, 2, 3)) + ")/3) as raw from refs join sl using (target_id))",
     "own as (select j.event_id as target_id, n, days, cells, sqrt((" + "+".join(f"power(greatest((v{k}-m{k})/s{k},0),2)" for k in (1, 2, 3)) + ")/3) as raw from pj j join sl on sl.target_id=j.event_id where v1 is not null and v2 is not null and v3 is not null)",
     "rk as (select own.target_id, (count_if(rr.raw < own.raw-1e-12)+count_if(rr.raw <= own.raw+1e-12)+1)/(2.0*(own.n+1)) as sc from own join rr using (target_id) where own.n >= 32 and own.days >= 8 and own.cells >= 3 group by own.target_id, own.n)"),
    "score_gate": _w("scored", "select event_id, score_status from gate", _SCORED_GATE),
    "decision_basis": _w("scored", """select event_id, decision, case when score_status='scored' then 'context=' || source_context || '; ' || case when score_method='vegetation_peer' then 'comparison=vegetation_peers; references=' || peer_reference_count else 'history_events=' || history_event_count end || '; evidence_score=' || printf('%.3f', anomaly_score) || '; sentinel=unavailable'
 else 'context=' || source_context || '; anomaly score unavailable; reason=' || score_status || '; ' || case when score_status='no_recurrent_site' then 'The event belongs to no recurrent site, so there is no history to compare with.'
 when score_status='insufficient_site_history' then history_event_count || ' comparable earlier events at the site, 6 are needed.' when score_status='insufficient_features' then model_feature_count || ' features can be compared, 3 are needed.'
 when score_status='unknown_daynight' then 'The phase of the day is unknown, so there is no calibration group.' when score_status='insufficient_calibration' then calibration_event_count || ' earlier events to calibrate on, 32 are needed.'
 when score_status='diagnostics_unavailable' then 'No score was recorded, and the diagnostics don''t tell why.' else 'No suitable comparison with vegetation peers.' end end as basis from decided""", _SCORED_GATE),
    "provisional_flag": _w("episodes", "select event_id, end_time > timestamp '1999-05-31 00:00:00' as provisional from episodes"),
    "interpretation_summary": _w("scored", "select kind, value, count(*) as n from (select 'score_status' as kind, score_status as value from decided union all select 'score_method', score_method from decided union all select 'source_context', source_context from decided union all select 'review_context', source_context from decided where anomaly_score >= 0.95) x where value is not null group by all", _SCORED_GATE),
    "ranked_candidates": _w("scored", "select event_id, anomaly_score, start_time from scored order by coalesce(anomaly_score,-1) desc, coalesce(frp_peak_mw,0) desc, start_time desc, event_id limit 500"),
    "round_robin": _w("scored", "select event_id, y as year, row_number() over (partition by y order by k, f) as turn from (select event_id, year(start_time)::bigint as y, row_number() over (partition by year(start_time), site_id order by event_id) as k, min(event_id) over (partition by year(start_time), site_id) as f from scored where site_id<>'' and context_label='vegetation_associated') q"),
    "capped_selection": _w("scored", """select event_id, selection from (select event_id, arg_min(selection, (tier, n)) as selection, min((tier, n)) as p from (
 select event_id, 'vegetation_sample' as selection, 0 as tier, 0 as n from res union all select event_id, 'recent_event', 1, 0 from fresh union all
 select event_id, 'industrial_high', 2, rk from b where grp='industrial_high' union all select event_id, 'mixed_unusual', 3, rk from b where grp='mixed_unusual' union all select event_id, 'vegetation_sample', 4, t from veg) u group by 1) v order by p, event_id limit 200""",
     """b as (select *, row_number() over (order by coalesce(anomaly_score,-1) desc, coalesce(frp_peak_mw,0) desc, start_time desc, event_id) as rk, case when context_label like '%industrial%' and anomaly_score >= 0.95 then 'industrial_high' when context_label like '%mixed%' and anomaly_score >= 0.95 then 'mixed_unusual' when context_label like '%vegetation%' then 'vegetation_sample' else 'other' end as grp from scored)""",
     """lap as (select *, row_number() over (partition by year(start_time), sk order by rk) as l, min(rk) over (partition by year(start_time), sk) as f from (select *, case when trim(site_id)='' then round(longitude,2) || ',' || round(latitude,2) else site_id end as sk from b where grp='vegetation_sample') q)""",
     "tn as (select *, row_number() over (partition by year(start_time) order by l, f) as k from lap)", "veg as (select event_id, row_number() over (order by k, year(start_time)) as t from tn)", "res as (select event_id from veg where t <= 40)",
     "fresh as (select event_id from b where start_time >= timestamp '2001-09-01' - interval 90 days and event_id not in (select event_id from res) order by start_time desc, rk limit 40)"),
    "catalogue_interval": _w("facilities episodes", "select event_id, collection, tile, side, scene_id, lag::bigint as lag from kept", _SCENES),
    "pair_rank": _w("facilities episodes", "select event_id, pre_scene, post_scene, k as pair_rank from (select a.event_id, a.scene_id as pre_scene, b.scene_id as post_scene, row_number() over (partition by a.event_id order by a.collection='sentinel-2-l2a', a.lag+b.lag, a.cloud+b.cloud, case a.collection when 'sentinel-2-c1-l2a' then 0 else 1 end, a.scene_id, b.scene_id) as k from kept a join kept b on a.event_id=b.event_id and a.collection=b.collection and a.tile=b.tile and a.nir=b.nir where a.side='pre' and b.side='post') q where k <= 4", _SCENES),
    "nbr_stats": "with " + _PIX + " select pair, pixels, valid_pixels, " + ", ".join(f"round({c},6) as {c}" for c in ("joint_valid_fraction", "dnbr_mean", "dnbr_median", "affected_fraction", "swir12_relative_change", "normalized_swir_change", "swir_affected_fraction", "pre_cloud_fraction")) + ", affected_area_m2 from st",
    "change_rule": "with " + _PIX + " select pair, case when joint_valid_fraction >= 0.4 then 'analysed' else 'cloud_obscured' end as status, case when not joint_valid_fraction >= 0.4 then 'inconclusive' when dnbr_mean >= 0.1 and affected_fraction >= 0.1 then 'observed_burn_like_change' when abs(swir12_relative_change) >= 0.2 and abs(normalized_swir_change) >= 0.02 and swir_affected_fraction >= 0.1 then 'observed_swir_change' else 'no_clear_change' end as evidence from st",
    "evidence_reuse": _w("episodes", "select event_id, case when ok then 'analysed' else 'queued' end as status, case when ok then 'old' else 'new' end as evidence, ok as reused from (select event_id, event_id%3<>0 and event_id%7<>0 and event_id%11<>0 and event_id%5<>0 as ok from episodes) q"),
    "scale_reflectance": "select p_partkey, round(case when p_partkey%9<>0 and p_size%7 not in (0,3) then (p_size%7)*100*0.0001e0-0.1e0 end,6) as value from part",
    "ui_filter": _w("scored", "select event_id, site_id, anomaly_score from decided where decision='likely_vegetation_fire' and coalesce(anomaly_score,9) >= 0.3 and end_time >= timestamp '1996-01-01' and start_time <= timestamp '1998-12-31' and position('s1' in lower(event_id || ' ' || site_id || ' ' || context_label || ' ' || source_context || ' ' || score_status || ' ' || decision)) > 0", _SCORED_GATE),
    "ui_window_ist": _w("scored", "select event_id, start_time, end_time from scored where end_time >= timestamp '1997-02-28 18:30:00' and start_time < timestamp '1997-03-31 18:30:00'"),
    "ui_page": _w("scored", "select event_id, anomaly_score from scored order by coalesce(anomaly_score,-1) desc, event_id limit 60 offset 60"),
    "ui_headline": _w("scored", "select count(*) as events, count(anomaly_score) as scored, count(*)-count(anomaly_score) as unscored, count(*) filter (decision like 'suspected%') as suspected, min(start_time) as first, max(end_time) as last from decided", _SCORED_GATE),
    "ui_grid_cluster": _w("scored", "select floor(131072e0*(longitude+180)/360/25)::bigint as cell_x, floor(131072e0*(0.5e0-ln((1+sin(radians(latitude)))/(1-sin(radians(latitude))))/(4*pi()))/25)::bigint as cell_y, decision, count(*) as n, round(avg(latitude),6) as latitude, round(avg(longitude),6) as longitude from decided group by 1,2,3", _SCORED_GATE),
    "ui_facility_search": _w("facilities", "select facility_id, name, kind from facilities where name || ' ' || kind || ' ' || facility_id ilike '%quarry%' order by name, facility_id limit 40"),
    "ui_comparison": _w("scored", "select event_id, case when p then 'Vegetation peers' else 'Same-site history' end as comparison, case when p then peer_reference_count else history_event_count end as comparison_references from (select *, score_method='vegetation_peer' or (coalesce(peer_status,'not_applicable')<>'not_applicable' and anomaly_score is null) as p from scored) q"),
    "monthly_pivot": _w("detections", "select strftime(acquired_at,'%Y-%m') as month, " + ", ".join(f"count(*) filter (sensor='{x}') as {x.lower()}" for x in ("VIIRS_SNPP", "VIIRS_NOAA20", "VIIRS_NOAA21", "MODIS_TERRA")) + " from detections group by 1"),
    "decision_distribution": _w("scored", "select decision as value, count(*) as n, round(100.0*count(*)/sum(count(*)) over (),6) as percent from decided group by 1", _SCORED_GATE),
    "score_histogram": _w("scored", "select case when anomaly_score is null then -1 when anomaly_score >= 0.9 then 9 else floor(anomaly_score*10)::int end as bin, count(*) as n from scored group by 1"),
    "stability_pivot": "select (p_size%3)::bigint as km, " + ", ".join(f"round(max(p_retailprice%100/100) filter (p_partkey%3={h}),6) as h{h}" for h in range(3)) + " from part group by 1",
    "silver_matrix": _w("scored detections", """select r.silver, count(*) filter (p='i') as industrial, count(*) filter (p='v') as vegetation, count(*) filter (p='a') as abstain from (values ('Static source (Type 2)'), ('Vegetation (Type 0)')) r(silver) left join
 (select g.silver, case e.context_label when 'industrial_associated' then 'i' when 'vegetation_associated' then 'v' else 'a' end as p from scored e join (select k, case when t2 >= 0.8 then 'Static source (Type 2)' when 1-t2 >= 0.8 then 'Vegetation (Type 0)' end as silver from (select floor(event_id/4)::bigint as k, count(*) as n, avg((firms_type_reference=2)::int) as t2 from detections where firms_type_reference in (0,2) group by 1) a where n >= 2) g on g.k=e.event_id) x on x.silver=r.silver group by 1"""),
    "summary_stats": _w("scored", "select count(*) as events, min(start_time) as first, max(end_time) as last, round(median(anomaly_score),6) as median_score, count(anomaly_score) as scored, round(count(anomaly_score)/count(*)::double,6) as coverage from scored"),
    "freshness": _w("detections", "select max(acquired_at) as latest, max(acquired_at) filter (data_quality='near_real_time') as latest_live, count(*) filter (data_quality='near_real_time') as live_rows, round(epoch(timestamp '2024-01-31' - max(acquired_at) filter (data_quality='near_real_time'))/3600,6) as age_hours, case when max(acquired_at) filter (data_quality='near_real_time') >= timestamp '2024-01-30' then 'fresh' else 'stale' end as status from detections"),
    "table_counts": "select 'detections' as name, count(*) as rows from events union all select 'episodes', count(*) from orders union all select 'facilities', count(*) from supplier",
    "validate_violations": _w("scored", "select 'duplicate_id' as rule, event_id::varchar as subject from bad group by event_id having count(*) > 1 union all select 'invalid_score', event_id::varchar from bad where event_id%777=5 union all select 'row_count', count(*)::varchar from bad", "bad as (select event_id from scored union all select event_id from scored where event_id%500=3)"),
    "compare_results": _w("scored", "select * from (" + " union all ".join(f"select '{n}' as measure, count(*) filter ({c}) as n from j" for n, c in (("reference_events", "a is not null"), ("rebuilt_events", "b is not null"), ("added_event_ids", "a is null"), ("removed_event_ids", "b is null"), ("changed_decision", "a=b and da<>db"), ("changed_source_context", "a=b and ca<>cb"), ("changed_site_id", "a=b and ia<>ib"), ("changed_anomaly_score", "a=b and (abs(sa-sb) > 1e-12 or (sa is null)<>(sb is null))"))) + ") q", _SCORED_GATE, _VERS),
    "keyset_agreement": _w("scored", "select issue, count(*) as n from (select case when b is null then 'only_left' when a is null then 'only_right' when sa is distinct from sb or ia is distinct from ib then 'different' end as issue from j) q where issue is not null group by 1", _SCORED_GATE, _VERS),
    "ari": _w("episodes", "select round((s-e)/(t-e),6) as ari from (select s, sa*sb/(n*(n-1)/2.0) as e, (sa+sb)/2.0 as t from (select sum(k*(k-1)/2.0) as s, sum(k) as n from c), (select sum(k*(k-1)/2.0) as sa from (select sum(k) as k from c group by a)), (select sum(k*(k-1)/2.0) as sb from (select sum(k) as k from c group by b))) q", "c as (select event_id%37 as a, site_id as b, count(*)::double as k from episodes group by 1,2)"),
    "trial_stats": "with " + _RUNS + " select trial, round(avg(ari),6) as subsample_ari, round(min(ari),6) as subsample_ari_min, round(max(ari),6) as subsample_ari_max, round(stddev_pop(ari),6) as subsample_ari_std from runs group by 1",
    "best_trial": "with " + _RUNS + " select trial, round(o,6) as objective from (select trial, 0.6e0*avg(ari)+0.2e0*trial/10.0e0+0.2e0*0.75e0 as o from runs where trial<>8 group by trial) q order by o desc limit 1",
    "shard_index": _w("episodes", "select event_id, floor((k-1)/256)::bigint as shard, ((k-1)%256)::bigint as shard_index from (select event_id, row_number() over (order by event_id) as k from episodes) q"),
    "geojson_rows": _w("scored", "select event_id, 'Feature' as type, site_id, 'Point' as geometry, history_event_count as history from scored"),
    "safe_paths": "select page_id, case page_id%6 when 0 then 'a/' || page_id || '.png' when 3 then 'b c.JPEG' when 4 then 'd/e.webp' end as safe from pages",
    "peer_reference_digest": _w("episodes", "select target_id, count(*) as peer_reference_count, sha256(string_agg(event_id || ',' || v1 || ',' || v2 || ',' || v3, chr(10) order by day, cast(event_id as varchar))) as digest from refs group by 1", *_peer(_PEERS)),
    "season_distance": _w("episodes", "select event_id, least(abs(dayofyear(start_time)-10), 366-abs(dayofyear(start_time)-10))::bigint as days from episodes"),
    "flagship": _w("detections", """select s.cluster, start_time, end_time, detection_count, observation_count, frp_peak_mw, detection_peak from (select cluster, count(*) as observation_count, round(max(fs),6) as frp_peak_mw, max(ds) as detection_peak from s group by 1) s
 join (select cluster, min(acquired_at) as start_time, max(acquired_at) as end_time, count(*) as detection_count from c group by 1) r on r.cluster=s.cluster""", _CL.replace("from detections)", "from detections where latitude between 23.2 and 25.2 and longitude between 81.5 and 83.5)"), _SNAP),
}
