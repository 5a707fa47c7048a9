"""Views that shape the general test tables like point detections, episodes, facilities and pixels.

One SQL text serves Spark and an independent SQL engine, so both see the same inputs. ``{name}`` stands for
a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "detections": """
select event_id, ts as acquired_at, user_id,
  23.2e0 + ((user_id*37) % 200)/100.0e0 + (event_id % 5)*0.002e0 as latitude,
  81.5e0 + ((user_id*53) % 200)/100.0e0 + (event_id % 7)*0.002e0 as longitude,
  case when event_id%10<6 then 'VIIRS_SNPP' when event_id%10<9 then 'VIIRS_NOAA20' else 'MODIS_TERRA' end as sensor,
  case when hour(ts) between 6 and 17 then 'D' else 'N' end as daynight,
  case when value>0.5e0 then value end as frp, event_type,
  300e0 + (event_id % 61) as brightness, cast(event_id % 23 as double) as brightness_temperature_difference,
  (event_id % 11)/10.0e0 as confidence_score,
  case event_id % 4 when 0 then 2e0 when 1 then 0e0 when 2 then 3e0 end as firms_type_reference,
  case when event_id % 13 = 0 then 'near_real_time' else 'science_quality' end as data_quality,
  concat('D', cast(event_id as varchar(20))) as detection_id
from {events}""",
    "raw_detections": """
select event_id as row_no,
  case when event_id % 97 = 0 then 'bad' when event_id % 89 = 0 then '95.0'
       else cast(round(23.2e0 + ((user_id*37) % 200)/100.0e0, 2) as varchar(30)) end as latitude,
  cast(round(81.5e0 + ((user_id*53) % 200)/100.0e0, 2) as varchar(30)) as longitude,
  substr(cast(ts as varchar(30)),1,10) as acq_date,
  case when event_id % 83 = 0 then '12345'
       when event_id % 3 = 0 then concat(cast(hour(ts)*100+minute(ts) as varchar(10)),'.0')
       else cast(hour(ts)*100+minute(ts) as varchar(10)) end as acq_time,
  case event_id % 7 when 0 then 'N' when 1 then 'n20' when 2 then 'NOAA-20' when 3 then 'J1'
       when 4 then 'Terra' when 5 then 'Suomi NPP' else 'XX' end as satellite,
  case when event_id % 7 = 4 then 'MODIS' else 'VIIRS' end as instrument,
  case event_id % 5 when 0 then 'low' when 1 then ' N ' when 2 then 'h' when 3 then '80' else 'zz' end as confidence,
  case event_id % 4 when 0 then '2.0NRT' when 1 then '2' when 2 then '6.1' else 'unknown' end as version,
  case when event_id % 11 = 0 then 0.0e0 when event_id % 13 = 0 then null else value end as frp,
  case when event_id % 2 = 0 then '330.5' else '310' end as bright_ti4, '300' as bright_ti5,
  '320' as brightness, case when event_id % 9 = 0 then 'x' else '295.5' end as bright_t31,
  concat('file', cast(event_id % 3 as varchar(3))) as source_file
from {events}""",
    "episodes": """
select cast(o_orderkey as bigint) as event_id,
  case when o_custkey % 10 = 0 then '' else concat('S', cast(o_custkey % 40 as varchar(10))) end as site_id,
  case o_orderkey % 3 when 0 then 'VIIRS_SNPP' when 1 then 'VIIRS_NOAA20' else 'VIIRS_NOAA21' end as model_sensor,
  case o_orderstatus when 'F' then 'D' when 'O' then 'N' else 'unknown' end as model_daynight,
  o_orderdate + (o_orderkey % 24) * interval '1' hour as start_time,
  o_orderdate + (o_orderkey % 24 + o_orderkey % 5) * interval '1' hour as end_time,
  23.2e0 + ((o_custkey*37) % 200)/100.0e0 as latitude, 81.5e0 + ((o_custkey*53) % 200)/100.0e0 as longitude,
  case when o_orderkey % 20 = 0 then 'near_real_time' when o_orderkey % 33 = 0 then 'near_real_time|science_quality'
       else 'science_quality' end as data_quality,
  case o_custkey % 4 when 0 then 'vegetation_associated' when 1 then 'industrial_associated'
       when 2 then 'mixed' else 'unknown' end as context_label,
  case o_custkey % 3 when 0 then 'tree_cover' when 1 then 'cropland' else 'built_up' end as worldcover_dominant,
  case when o_custkey % 17 = 0 then 0.5e0 else 1.0e0 end as worldcover_coverage,
  case when o_orderkey % 41 = 0 then null else o_totalprice/1000.0e0 end as frp_peak_mw,
  o_totalprice/2000.0e0 as frp_median_mw,
  cast(1 + o_orderkey % 9 as double) as detection_peak,
  cast(o_orderkey % 5 as double) as duration_hours, (o_orderkey % 29)/10.0e0 as spread_km,
  (o_orderkey % 37)/2.0e0 as brightness_temperature_difference_max,
  cast(1 + o_orderkey % 7 as bigint) as detection_count
from {orders}""",
    "facilities": """
select cast(s_suppkey as bigint) as fac_ord, concat('osm:way:', cast(s_suppkey as varchar(10))) as facility_id, s_name as name,
  case s_nationkey % 4 when 0 then 'power=plant' when 1 then 'landuse=industrial'
       when 2 then 'landuse=quarry' else 'man_made=works' end as kind,
  23.2e0 + ((s_suppkey*71) % 200)/100.0e0 as lat0, 81.5e0 + ((s_suppkey*29) % 200)/100.0e0 as lon0,
  (1 + s_suppkey % 5)*0.003e0 as half
from {supplier}""",
    "landcover": """
select cast(p_partkey % 100 as bigint) as px_col, cast(floor(p_partkey / 100.0e0) as bigint) as px_row, p_size,
  case p_size % 6 when 0 then 10 when 1 then 30 when 2 then 40 when 3 then 50 when 4 then 60 else 80 end as code
from {part}""",
    "scored": """
select event_id, site_id, model_sensor, model_daynight, start_time, end_time, latitude, longitude, data_quality, context_label,
  case when event_id % 7 = 0 then null else cast((event_id * 7919) % 1000 as double)/1000.0e0 end as anomaly_score,
  case event_id % 5 when 0 then 'landuse=quarry' when 1 then ' Landuse=Quarry ' when 2 then 'power=plant' end as nearest_facility_kind,
  case event_id % 6 when 0 then 'not_applicable' when 1 then 'scored' when 2 then 'insufficient_peers' end as peer_status,
  cast(event_id % 15 as bigint) as history_event_count, cast(event_id % 6 as bigint) as model_feature_count,
  cast(event_id % 60 as bigint) as calibration_event_count, cast(event_id % 50 as bigint) as peer_reference_count,
  case when event_id % 3 = 0 then 'vegetation_peer' else 'site_history' end as score_method,
  frp_peak_mw, detection_count
from ({episodes}) e0""",
}


def sql_of(name: str) -> str:
    """The view as SQL over the plain table names."""
    parts = {t: t for t in ("events", "orders", "supplier", "part")}
    if name == "scored":
        parts["episodes"] = sql_of("episodes")
    return VIEWS[name].format(**parts)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view over the Parquet tables of ``sf_dir``."""
    needed = {"detections": "events", "raw_detections": "events", "episodes": "orders", "scored": "orders", "facilities": "supplier", "landcover": "part"}[name]
    text = VIEWS[name] if name != "scored" else VIEWS[name].replace("{episodes}", VIEWS["episodes"])
    return spark.sql(text, **{needed: spark.read.parquet(f"{sf_dir}/{needed}.parquet")})
