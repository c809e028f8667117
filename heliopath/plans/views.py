"""Domain-shaped views over the generic test tables, as SQL for both engines."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]
LINE_ORDER = "l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate"

VIEWS = {
    "fx_route_vertices": f"""
SELECT route_id, v_idx,
       ROUND(30.0 + CAST((route_id * 7919) % 100000 AS DOUBLE) / 10000.0 + CAST(SUM(dlat) OVER w AS DOUBLE) / 100000.0, 6) AS lat,
       ROUND(-120.0 + CAST((route_id * 104729) % 400000 AS DOUBLE) / 10000.0 + CAST(SUM(dlng) OVER w AS DOUBLE) / 100000.0, 6) AS lng
FROM (SELECT l_orderkey AS route_id,
             CAST(ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY {LINE_ORDER}) - 1 AS BIGINT) AS v_idx,
             (l_partkey * 37) % 200 - 60 AS dlat, (l_suppkey * 53 + l_partkey * 11) % 200 - 40 AS dlng
      FROM {{lineitem}}) s
WINDOW w AS (PARTITION BY route_id ORDER BY v_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "fx_route_candidates": """
SELECT o_custkey AS od_id, o_orderkey AS route_id,
       CAST(ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS BIGINT) AS candidate_index,
       CAST(600 + (o_orderkey * 13) % 400 AS DOUBLE) AS duration_sec,
       CAST((o_orderkey * 31) % 100 AS DOUBLE) / 100.0 AS avg_glare,
       CAST((600 + (o_orderkey * 13) % 400) * ((o_orderkey * 17) % 100) AS DOUBLE) / 100.0 AS sunlit_s,
       CAST((o_orderkey * 29) % 1500 AS DOUBLE) / 10.0 AS direct_wh,
       CAST((o_orderkey * 41) % 100 AS DOUBLE) / 100.0 AS shade,
       CASE WHEN o_orderstatus = 'P' THEN 'hybrid-scene' WHEN o_orderstatus = 'F' THEN 'scene' ELSE 'heuristic' END AS analysis_mode
FROM {orders}""",
    "fx_steps": f"""
SELECT l_orderkey AS route_id,
       CAST(ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY {LINE_ORDER}) - 1 AS BIGINT) AS step_idx,
       CAST((l_partkey * 13) % 400 AS DOUBLE) AS distance, CAST((l_suppkey * 7 + l_partkey) % 60 AS DOUBLE) AS duration
FROM {{lineitem}}""",
    "fx_gps_fixes": """
SELECT session_id, fix_id, source, accuracy, reported_speed_kmh, hw_heading,
       CAST(1704067200000 + SUM(gap_ms) OVER w AS BIGINT) AS fix_ms,
       CAST(42000000 + (session_id * 7919) % 500000 + SUM(dlat) OVER w AS DOUBLE) / 1000000.0 AS lat,
       CAST(-71000000 - (session_id * 3571) % 500000 + SUM(dlng) OVER w AS DOUBLE) / 1000000.0 AS lng
FROM (SELECT user_id AS session_id, event_id AS fix_id,
             CASE WHEN event_type = 'purchase' THEN 'native-gps' ELSE 'web-watch' END AS source,
             CAST(5 + (event_id * 17) % 60 AS DOUBLE) AS accuracy,
             CASE WHEN event_id % 4 = 0 THEN NULL ELSE CAST((event_id * 7) % 1200 AS DOUBLE) / 10.0 END AS reported_speed_kmh,
             CASE WHEN event_type = 'error' THEN NULL ELSE CAST((event_id * 97) % 3600 AS DOUBLE) / 10.0 END AS hw_heading,
             400 + (event_id * 613) % 5000 AS gap_ms,
             (event_id * 211) % 600 - 250 + CASE WHEN event_id % 53 = 0 THEN 20000 ELSE 0 END AS dlat,
             (event_id * 307) % 600 - 280 AS dlng
      FROM {events}) s
WINDOW w AS (PARTITION BY session_id ORDER BY fix_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "fx_terrain": """
SELECT p_partkey AS sample_id, CAST((p_partkey % 50) * 100 AS DOUBLE) AS x, CAST(FLOOR(p_partkey / 50.0) * 100 AS DOUBLE) AS y,
       CAST(50 + (p_partkey * 131) % 200 AS DOUBLE) AS elevation FROM {part}""",
    "fx_buildings": """
SELECT c_custkey AS building_id, CAST((c_custkey * 733) % 5000 AS DOUBLE) AS cx, CAST((c_custkey * 419) % 4000 AS DOUBLE) AS cy,
       CAST(5 + c_nationkey AS DOUBLE) AS half_m,
       CASE c_mktsegment WHEN 'BUILDING' THEN '12 m' WHEN 'MACHINERY' THEN '30 ft' ELSE NULL END AS tag_height,
       CASE c_mktsegment WHEN 'HOUSEHOLD' THEN '3' WHEN 'FURNITURE' THEN '2' ELSE NULL END AS tag_levels,
       CASE WHEN c_custkey % 10 = 0 THEN '12' ELSE NULL END AS tag_min_height,
       CASE c_mktsegment WHEN 'FURNITURE' THEN '3' ELSE NULL END AS tag_min_level
FROM {customer}""",
    "fx_osm_nodes": """
SELECT p_partkey AS node_id, 42.0 + CAST((p_partkey * 97) % 1000 AS DOUBLE) / 10000.0 AS lat,
       -71.0 - CAST((p_partkey * 61) % 1000 AS DOUBLE) / 10000.0 AS lng FROM {part} WHERE p_partkey % 37 <> 0""",
    "fx_osm_way_refs": f"""
SELECT l_orderkey AS way_id,
       CAST(ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY {LINE_ORDER}) - 1 AS BIGINT) AS pos,
       l_partkey AS node_id,
       CASE l_orderkey % 5 WHEN 0 THEN 'building' WHEN 1 THEN 'tunnel' WHEN 2 THEN 'covered' ELSE 'highway' END AS way_kind
FROM {{lineitem}}""",
    "fx_road_tags": """
SELECT p_partkey AS way_id,
       CASE p_partkey % 9 WHEN 0 THEN '30 mph' WHEN 1 THEN '50 km/h' WHEN 2 THEN '50' WHEN 3 THEN 'signals' WHEN 4 THEN 'none'
            WHEN 5 THEN '70 mph' WHEN 6 THEN '30,5' WHEN 7 THEN '999' ELSE NULL END AS maxspeed,
       CASE p_size % 4 WHEN 0 THEN 'US' WHEN 1 THEN 'GB' WHEN 2 THEN 'KR' ELSE 'INT' END AS country,
       CASE WHEN p_size % 5 = 0 THEN 'motorway' WHEN p_size % 5 = 1 THEN 'motorway_link' ELSE 'primary' END AS highway,
       CASE WHEN p_partkey % 3 = 0 THEN 'yes' ELSE 'no' END AS toll, p_name AS name
FROM {part}""",
    "fx_tiles": """
SELECT c_custkey AS tile_no, CAST(c_custkey % 40 AS BIGINT) AS tx, CAST(FLOOR(c_custkey / 40.0) AS BIGINT) AS ty,
       20000 + (c_custkey * 7919) % 300000 AS zip_bytes FROM {customer}""",
    "fx_ray_points": """
SELECT s_suppkey AS point_id, CAST((s_suppkey * 577) % 5000 AS DOUBLE) AS x, CAST((s_suppkey * 331) % 4000 AS DOUBLE) AS y,
       CAST((s_suppkey * 47) % 360 AS DOUBLE) AS sun_azimuth, CAST(2 + (s_suppkey * 13) % 40 AS DOUBLE) AS sun_altitude
FROM {supplier}""",
    "fx_place_results": """
SELECT p_partkey AS result_id, p_partkey % 50 AS query_id,
       CASE WHEN p_partkey % 3 = 0 THEN 'nominatim' ELSE 'photon' END AS source,
       CONCAT(p_size, ' ', p_name, ' Road') AS display_name, CAST(p_size AS BIGINT) AS house_number,
       40.0 + CAST((p_partkey * 83) % 2000 AS DOUBLE) / 10000.0 AS lat, -74.0 - CAST((p_partkey * 59) % 2000 AS DOUBLE) / 10000.0 AS lng,
       p_retailprice / 10000.0 AS importance
FROM {part}""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The column by which a view's windows are dealt.
DEALT = {"fx_route_vertices": "l_orderkey", "fx_route_candidates": "o_custkey", "fx_steps": "l_orderkey", "fx_gps_fixes": "user_id",
         "fx_osm_way_refs": "l_orderkey"}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view's rows. Tables under windows are dealt out as read, before columns are made of theirs: that is narrower, goes for all
    windows of the view, and readers of one table in a plan share it."""
    text = VIEWS[name]
    used = {t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in text}
    if name in DEALT:
        words = set(re.findall(r"\w+", text))
        used = {t: df.select(*[c for c in df.columns if c in words]).repartition(DEALT[name]) for t, df in used.items()}
    return spark.sql(text, **used)


def ntz_ms(column: str):
    """Epoch milliseconds of a zone-less timestamp read as UTC."""
    c = F.col(column)
    seconds = F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)
    millis = F.floor(F.date_part(F.lit("SECOND"), c) * 1000) - F.second(c) * 1000
    return ((F.unix_date(c.cast("date")).cast("long") * 86400 + seconds) * 1000 + millis).cast("long")


def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """route_id, duration_sec and a departure spread over the hours of the day."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("route_id"),
                    (F.lit(600) + (F.col("o_orderkey") * 13) % 400).cast("double").alias("duration_sec"),
                    (F.unix_date(F.col("o_orderdate").cast("date")).cast("long") * 86400000
                     + (F.col("o_orderkey") * 37) % 24 * 3600000).alias("start_ms"))


ROUTES_SQL = """
SELECT o_orderkey AS route_id, CAST(600 + (o_orderkey * 13) % 400 AS DOUBLE) AS duration_sec,
       CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) * 86400000 + (o_orderkey * 37) % 24 * 3600000 AS start_ms
FROM orders"""


def cte(*names: str) -> str:
    """WITH clause text of views for the oracle engine."""
    bare = {t: t for t in TABLES}
    parts = [f"{n} AS ({ROUTES_SQL if n == 'fx_routes' else VIEWS[n].format(**bare)})" for n in names]
    return "WITH " + ",\n".join(parts)
