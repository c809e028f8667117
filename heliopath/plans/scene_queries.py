"""Scene build, tiles, coverage and occlusion queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo, osm, solar
from ..operators import occlusion, paths, tiles
from ..operators.spatial import nearest_any, nearest_of_places, nearest_within, settled
from ..session import cut_lineage
from ..sources import scene_build as build
from . import sqltext as S
from .registry import query, rounded
from .views import cte, routes, table, view

SHAPES = """pt AS (SELECT way_id, pos, way_kind, lat, lng FROM fx_osm_way_refs JOIN fx_osm_nodes USING (node_id)),
sh AS (SELECT way_id, way_kind, count(*) n, avg(lat) cla, avg(lng) cln, min(lat) south, max(lat) north, min(lng) west, max(lng) east,
 string_agg(concat(lat,' ',lng), ';' ORDER BY pos) line FROM pt GROUP BY ALL HAVING count(*)>=CASE WHEN way_kind='building' THEN 3 ELSE 2 END),
sg AS (SELECT *, CAST(floor(radians(cln+81)*6371000*cos(radians(43))/5000) AS BIGINT) tx, CAST(floor(radians(cla-38)*6371000/5000) AS BIGINT) ty FROM sh)"""
WAYS = cte("fx_osm_nodes", "fx_osm_way_refs", "fx_buildings")
DEM = """dem AS (SELECT DISTINCT CAST(floor(lat) AS INTEGER) n, CAST(floor(lng) AS INTEGER) w FROM fx_osm_nodes)"""


def _points(spark, sf):
    return build.way_points(view(spark, sf, "fx_osm_way_refs"), view(spark, sf, "fx_osm_nodes"))


def _shapes(spark, sf):
    return build.way_shapes(_points(spark, sf))


def _dem(spark, sf):
    """Raster lines for every degree square with nodes; (row * 7 + col * 13) % 400, void below 5."""
    squares = view(spark, sf, "fx_osm_nodes").select(F.floor("lat").cast("int").alias("north"), F.floor("lng").cast("int").alias("west")).distinct()
    rows = squares.withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(3600)))).repartition("north", "west", "row")
    value = lambda c: (F.col("row") * 7 + c * 13) % 400
    line = F.transform(F.sequence(F.lit(0), F.lit(3600)), lambda c: F.when(value(c) >= 5, value(c)).cast("smallint"))
    return rows.withColumn("elev", line)


def dem_sql(lat: str, lng: str) -> str:
    r = f"CAST(least(3600,greatest(0,floor((floor({lat})+1-{lat})*3600+0.5))) AS BIGINT)"
    c = f"CAST(least(3600,greatest(0,floor(({lng}-floor({lng}))*3600+0.5))) AS BIGINT)"
    v = f"(({r}*7+{c}*13)%400)"
    have = f"EXISTS (SELECT 1 FROM dem WHERE n=floor({lat}) AND w=floor({lng}))"
    return f"CASE WHEN {have} AND {v}>=5 THEN {v}::DOUBLE END"


@query("J1_A11_way_shapes", f"""{WAYS}, {SHAPES}
SELECT way_id, way_kind, n AS n_points, round(cla,8) AS center_lat, round(cln,8) AS center_lng, south, north, west, east, tx, ty FROM sg""")
def j1(spark, sf):
    out = rounded(build.with_tile(_shapes(spark, sf)), 8, "center_lat", "center_lng")
    return out.select("way_id", "way_kind", "n_points", "center_lat", "center_lng", "south", "north", "west", "east", "tx", "ty")


@query("P9_way_kinds", f"""{WAYS}
SELECT way_kind, count(DISTINCT way_id) AS ways, count(*) AS points FROM fx_osm_way_refs GROUP BY 1""")
def p9(spark, sf):
    tag = {"building": "building", "tunnel": "tunnel", "covered": "covered", "highway": "highway"}
    r = view(spark, sf, "fx_osm_way_refs")
    value = F.when(F.col("way_kind").isin("tunnel", "covered"), "yes").otherwise("primary")
    r = r.withColumn("tags", F.create_map("way_kind", value))
    kind = osm.way_kind("tags")
    named = F.when(kind == "tunnel", F.when(F.col("tags")["covered"].isNotNull(), "covered").otherwise("tunnel")).when(
        kind == "road", tag["highway"]).otherwise(kind)
    return r.groupBy(named.alias("way_kind")).agg(F.countDistinct("way_id").alias("ways"), F.count("*").alias("points"))


@query("X6_scene_tiles", f"""{WAYS}, {SHAPES}
SELECT DISTINCT CAST(floor(radians(lng+81)*6371000*cos(radians(43))/5000) AS BIGINT) AS tx, CAST(floor(radians(lat-38)*6371000/5000) AS BIGINT) AS ty FROM pt
UNION SELECT tx, ty FROM sg WHERE way_kind<>'highway'""")
def x6(spark, sf):
    lines = build.with_tile(_shapes(spark, sf).filter("way_kind <> 'highway'")).select("tx", "ty")
    return build.scene_tile_keys(_points(spark, sf)).unionByName(lines).distinct()


def _tags(spark, sf):
    b = view(spark, sf, "fx_buildings")
    return b.select(F.col("building_id").alias("way_id"), "tag_height", "tag_levels", "tag_min_height", "tag_min_level")


@query("D3_J6_building_table", f"""{WAYS}, {SHAPES}, {DEM}
SELECT tx, ty, concat('way/',way_id) AS id, {dem_sql('cla', 'cln')} AS ground,
 CASE tag_height WHEN '12 m' THEN 12.0 WHEN '30 ft' THEN 9.144 ELSE round(coalesce(CASE WHEN tag_min_height IS NOT NULL THEN 12 END,CAST(tag_min_level AS DOUBLE)*3.2,0)+coalesce(CAST(tag_levels AS DOUBLE)*3.2,6),3) END::DOUBLE AS height
FROM sg LEFT JOIN fx_buildings ON building_id=way_id WHERE way_kind='building'""")
def d3(spark, sf):
    return build.building_table(_shapes(spark, sf), _tags(spark, sf), _dem(spark, sf)).select("tx", "ty", "id", "ground", "height")


@query("D4_terrain_lattice", f"""{WAYS}, {SHAPES}, {DEM}, tl AS (SELECT DISTINCT tx, ty FROM sg WHERE way_kind='building'),
g AS (SELECT tx, ty, ix, iy, round(38+degrees((ty*5000+iy*100)/6371000.0),6) lat, round(-81+degrees((tx*5000+ix*100)/(6371000*cos(radians(43)))),6) lng FROM tl, range(51) a(ix), range(51) b(iy)),
e AS (SELECT *, {dem_sql('lat', 'lng')} el FROM g)
SELECT tx, ty, count(*) AS points, sum(el) AS total, min(el) AS lowest, max(el) AS highest FROM e WHERE el IS NOT NULL GROUP BY ALL""")
def d4(spark, sf):
    t = build.with_tile(_shapes(spark, sf).filter("way_kind = 'building'")).select("tx", "ty").distinct()
    rows = build.terrain_table(t, _dem(spark, sf))
    return rows.groupBy("tx", "ty").agg(F.count("*").alias("points"), F.sum("elevation").alias("total"),
                                        F.min("elevation").alias("lowest"), F.max("elevation").alias("highest"))


@query("A6_tile_stats", f"""{WAYS}, {SHAPES}, {DEM},
b AS (SELECT tx, ty, count(*) buildings, bool_and({dem_sql('cla', 'cln')} IS NOT NULL) g FROM sg WHERE way_kind='building' GROUP BY ALL),
t AS (SELECT tx, ty, count(*) tunnels FROM sg WHERE way_kind IN ('tunnel','covered') GROUP BY ALL), k AS (SELECT tx, ty FROM b UNION SELECT tx, ty FROM t)
SELECT tx, ty, coalesce(buildings,0) AS buildings, coalesce(g,true) AS building_ground, coalesce(tunnels,0) AS tunnels FROM k LEFT JOIN b USING (tx,ty) LEFT JOIN t USING (tx,ty)""")
def a6(spark, sf):
    shapes = _shapes(spark, sf)
    b = build.building_table(shapes, _tags(spark, sf), _dem(spark, sf))
    t = build.tunnel_table(shapes)
    keys = b.select("tx", "ty").union(t.select("tx", "ty")).distinct()
    none = keys.filter(F.lit(False))
    return build.tile_stats(keys, b, t, none).select("tx", "ty", "buildings", "building_ground", "tunnels")


@query("S6_pending_tiles", f"""{cte('fx_tiles')} SELECT tx, ty FROM fx_tiles WHERE tile_no%3<>0 OR tile_no%5=0""")
def s6(spark, sf):
    t = view(spark, sf, "fx_tiles")
    k = F.col("tile_no")
    wanted = t.select("tx", "ty", build.fingerprint(F.lit(3), "zip_bytes").alias("fingerprint"))
    old = t.filter(k % 3 == 0).select("tx", "ty", build.fingerprint(F.lit(3), F.when(k % 5 == 0, 0).otherwise(F.col("zip_bytes"))).alias("fingerprint"))
    return build.pending_tiles(wanted, old).select("tx", "ty")


@query("A17_first_copy", f"""{cte('fx_buildings')}, c AS (SELECT building_id%200 AS id, building_id%7 batch, building_id pos, half_m FROM fx_buildings)
SELECT id, pos, half_m FROM c QUALIFY row_number() OVER (PARTITION BY id ORDER BY batch, pos)=1""")
def a17(spark, sf):
    c = view(spark, sf, "fx_buildings").select((F.col("building_id") % 200).alias("id"), (F.col("building_id") % 7).alias("batch"),
                                               F.col("building_id").alias("pos"), "half_m")
    return tiles.first_of_each(c, "id", ["batch", "pos"]).select("id", "pos", "half_m")


@query("S4_normalized_buildings", f"""{cte('fx_buildings')},
r AS (SELECT building_id, 2+building_id%4 ver, CASE WHEN building_id%5=0 THEN 0.0 ELSE half_m END h, CASE WHEN building_id%3=0 THEN half_m END hl, building_id%2=0 est FROM fx_buildings)
SELECT building_id, CASE WHEN h<>0 THEN h ELSE 6 END::DOUBLE AS height, coalesce(hl,CASE WHEN h<>0 THEN h ELSE 6 END)::DOUBLE AS height_lower,
 CASE WHEN est THEN 'legacy-estimated' ELSE 'legacy-height' END AS height_source, 2.0::DOUBLE AS ground_error_m FROM r WHERE ver IN (2,3)""")
def s4(spark, sf):
    k = F.col("building_id")
    none = lambda t: F.lit(None).cast(t)
    r = view(spark, sf, "fx_buildings").select(
        "building_id", (2 + k % 4).alias("schema"), F.when(k % 5 == 0, 0.0).otherwise(F.col("half_m")).alias("height"),
        F.when(k % 3 == 0, F.col("half_m")).alias("height_lower"), none("double").alias("height_upper"), none("string").alias("height_source"),
        (k % 2 == 0).alias("height_estimated"), *[none("double").alias(c) for c in ("min_height", "min_height_lower", "min_height_upper", "ground_error_m")])
    out = build.normalize_scene_buildings(r.filter(build.supported_schema("schema")))
    return out.select("building_id", "height", "height_lower", "height_source", "ground_error_m")


# -- tiles along routes ------------------------------------------------------

VR = cte("fx_route_vertices", "fx_routes")
VS = f"vs AS MATERIALIZED ({S.sun('SELECT v.*, start_ms FROM fx_route_vertices v JOIN fx_routes USING (route_id)', 'lat', 'lng', 'start_ms')})"


def safe_sql(rel: str) -> str:
    """Tiles with edge neighbours of (route_id, lat, lng) rows."""
    return f"""SELECT DISTINCT route_id, tx+i AS tx, ty+j AS ty FROM (SELECT route_id, tx, ty,
 CASE WHEN gx-tx*5000<200 THEN -1 WHEN gx-tx*5000>4800 THEN 1 ELSE 0 END dx, CASE WHEN gy-ty*5000<200 THEN -1 WHEN gy-ty*5000>4800 THEN 1 ELSE 0 END dy
 FROM (SELECT *, CAST(floor(gx/5000) AS BIGINT) tx, CAST(floor(gy/5000) AS BIGINT) ty FROM (SELECT route_id, radians(lng+74)*6371000*cos(radians(42)) gx, radians(lat-41)*6371000 gy FROM ({rel})))),
 (VALUES (-1),(0),(1)) a(i), (VALUES (-1),(0),(1)) b(j) WHERE (i=0 OR i=dx) AND (j=0 OR j=dy)"""


_dl, _dg = S.dest("lat", "lng", "sun_azimuth", "m")
NEED = f"""{VS}, nd AS MATERIALIZED (SELECT DISTINCT * FROM ({safe_sql('SELECT route_id, lat, lng FROM fx_route_vertices')} UNION
 {safe_sql(f"SELECT route_id, {_dl} AS lat, {_dg} AS lng FROM vs, (VALUES (0.0::DOUBLE),(1000),(2000),(3000),(4000),(4500)) t(m)")}))"""


def _profiles(spark, sf):
    v = view(spark, sf, "fx_route_vertices").join(routes(spark, sf), "route_id")
    return solar.with_compact_sun(v, "lat", "lng", "start_ms")


def _required(spark, sf):
    p = _profiles(spark, sf)
    return tiles.required_tiles(p, p)


@query("J3_X2_required_tiles", f"{VR}, {NEED} SELECT route_id, tx, ty FROM nd")
def j3(spark, sf):
    return _required(spark, sf)


@query("J2_X3_tile_status", f"""{VR}, {NEED}
SELECT route_id, tx, ty, CASE WHEN (tx*7+ty)%5=0 THEN 'missing' WHEN (tx+ty)%11=0 THEN 'failed' ELSE 'loaded' END AS status FROM nd""")
def j2(spark, sf):
    need = cut_lineage(_required(spark, sf))  # read three times
    have = need.filter((F.col("tx") * 7 + F.col("ty")) % 5 != 0)
    return tiles.tile_status(need, have, have.filter((F.col("tx") + F.col("ty")) % 11 == 0))


_tile = lambda a, b: (f"CAST(floor(radians({b}+74)*6371000*cos(radians(42))/5000) AS BIGINT)", f"CAST(floor(radians({a}-41)*6371000/5000) AS BIGINT)")
_ok = lambda t: f"(({t[0]}*7+{t[1]})%5<>0)"
COVER = f"""{VS}, sg AS MATERIALIZED ({S.segments()}), mx AS (SELECT route_id, max(seg_idx) ls FROM sg GROUP BY 1),
pr AS (SELECT route_id, v_idx, lat, lng, sun_azimuth, v_idx%3<>2 cp FROM vs), pc AS (SELECT route_id, count(*) np FROM pr GROUP BY 1),
rt AS (SELECT route_id, v_idx, bool_and({_ok(_tile(_dl, _dg))}) rok FROM pr, (VALUES (0.0::DOUBLE),(250),(600),(1200),(2400),(4500)) t(m) WHERE cp GROUP BY ALL),
nr AS (SELECT s.route_id, seg_idx, arg_min(rok, abs(v_idx-seg_idx)*100000+v_idx) rok, min(abs(v_idx-seg_idx)) gap FROM sg s JOIN rt USING (route_id) GROUP BY ALL),
cv AS (SELECT s.route_id, s.seg_idx, {_ok(_tile('lat1', 'lng1'))} AND {_ok(_tile('lat2', 'lng2'))} tiles, coalesce(rok,false) ray, gap, (ls+2)/greatest(1,coalesce(np,0)-1)::DOUBLE sp
 FROM sg s JOIN mx USING (route_id) LEFT JOIN pc USING (route_id) LEFT JOIN nr ON nr.route_id=s.route_id AND nr.seg_idx=s.seg_idx)"""


def _coverage(spark, sf):
    seg = paths.with_last_segment(paths.route_segments(view(spark, sf, "fx_route_vertices")))
    need = _profiles(spark, sf).withColumn("complete", F.col("v_idx") % 3 != 2)
    good = lambda lat, lng: geo.tile_of(lat, lng)
    # Loaded tiles: every tile any segment or ray point touches, less one in five.
    reach = need.withColumn("_m", F.explode(F.array(*[F.lit(float(d)) for d in (0.0, *tiles.PROBES_M, tiles.RAY_M)])))
    lat, lng = geo.destination("lat", "lng", "sun_azimuth", "_m")
    tx, ty = good(lat, lng)
    t1 = reach.select("route_id", tx.alias("tx"), ty.alias("ty"))
    a, b = good("lat", "lng")
    loaded = t1.union(need.select("route_id", a, b)).distinct().filter((F.col("tx") * 7 + F.col("ty")) % 5 != 0)
    return tiles.segment_coverage(seg, loaded, need)


@query("J27_segment_coverage", f"""{VR}, {COVER}
SELECT route_id, seg_idx, tiles, ray AS ray_tiles, tiles AND ray AND coalesce(gap<=greatest(2,sp*1.5),false) AS terrain, tiles AND ray AS buildings FROM cv""")
def j27(spark, sf):
    return _coverage(spark, sf).select("route_id", "seg_idx", "tiles", "ray_tiles", "terrain", "buildings")


@query("A5_coverage_summary", f"""{VR}, {COVER}, c AS (SELECT route_id, tiles AND ray AND coalesce(gap<=greatest(2,sp*1.5),false) ok FROM cv)
SELECT route_id, count(*) AS segment_count, count(*) FILTER (WHERE ok) AS covered_segments, bool_and(ok) AS precision_ready,
 round(count(*) FILTER (WHERE ok)/count(*)::DOUBLE,6) AS segment_ratio, NOT bool_and(ok) AND count(*) FILTER (WHERE ok)>0 AS partial FROM c GROUP BY 1""")
def a5(spark, sf):
    return rounded(tiles.coverage_summary(_coverage(spark, sf)), 6, "segment_ratio")


@query("A18_merged_coverage", f"""{VR}, {COVER},
c AS (SELECT route_id, seg_idx, tiles AND ray b, tiles t, tiles AND ray AND coalesce(gap<=greatest(2,sp*1.5),false) e FROM cv)
SELECT route_id, seg_idx, bool_or(b AND k) AS buildings, bool_or(t AND k) AS tunnels, bool_or(e AND NOT k) AS terrain, bool_or(b AND NOT k) AS building_ground
FROM (SELECT *, true k FROM c UNION ALL SELECT *, false FROM c) GROUP BY ALL""")
def a18(spark, sf):
    c = _coverage(spark, sf).select("route_id", "seg_idx", "buildings", "tunnels", "terrain", "building_ground")
    off = F.lit(False)
    first = c.withColumns({"terrain": off, "building_ground": off})
    second = c.withColumns({"buildings": off, "tunnels": off})
    return tiles.merge_coverage(first.unionByName(second))


@query("A18_merged_regions", f"""{cte('fx_route_candidates')}
SELECT od_id AS route_id, count(*) AS regions, coalesce(max(CASE WHEN route_id%4<>0 THEN route_id%9 END),2)::DOUBLE AS terrain_error_m,
 CASE WHEN bool_and(route_id%3<>0) THEN 0.9::DOUBLE END AS confidence, bool_and(route_id%2=0) AS all_ready, CAST(sum(route_id%50) AS BIGINT) AS total_buildings, CAST(sum(route_id%4) AS BIGINT) AS missing_tiles FROM fx_route_candidates GROUP BY 1""")
def a18b(spark, sf):
    k = F.col("route_id")
    parts = view(spark, sf, "fx_route_candidates").select(
        F.col("od_id").alias("route_id"), F.when(k % 4 != 0, (k % 9).cast("double")).alias("terrain_error_m"),
        F.when(k % 3 != 0, 0.9).otherwise(0.5).alias("confidence"), (k % 2 == 0).alias("precision_ready"), (k % 50).alias("total_buildings"),
        (k % 4).alias("missing_tiles"), F.lit(1).alias("requested_tiles"), F.lit(1).alias("loaded_tiles"))
    return tiles.merge_regions(parts).drop("requested_tiles", "loaded_tiles")


@query("J19_W8_region_runs", f"""{cte('fx_route_vertices')},
rg AS (SELECT r_regionkey region, 30+r_regionkey*2.0 south, 32.0005+r_regionkey*2 north, -120+r_regionkey*8.0 west, -111.9995+r_regionkey*8 east FROM region),
j AS (SELECT route_id, region, v_idx, v_idx-row_number() OVER (PARTITION BY route_id, region ORDER BY v_idx) g FROM fx_route_vertices JOIN rg ON lat BETWEEN south AND north AND lng BETWEEN west AND east),
n AS (SELECT route_id, max(v_idx) l FROM fx_route_vertices GROUP BY 1),
k AS (SELECT route_id, region, g, greatest(0,min(v_idx)-1) run_start, max(v_idx)+1 z FROM j GROUP BY ALL)
SELECT route_id, region, run_start, least(l,z) AS run_end FROM k JOIN n USING (route_id) WHERE least(l,z)>run_start""")
def j19(spark, sf):
    k = F.col("r_regionkey")
    rg = table(spark, sf, "region").select(k.alias("region"), (30 + k * 2.0).alias("south"), (32.0005 + k * 2).alias("north"),
                                           (-120 + k * 8.0).alias("west"), (-111.9995 + k * 8).alias("east"))
    return tiles.region_runs(view(spark, sf, "fx_route_vertices"), rg)


@query("W9_route_pieces", f"""{cte('fx_route_vertices').replace('WITH', 'WITH RECURSIVE', 1)}, s AS MATERIALIZED ({S.segments()}),
st AS (SELECT route_id, CAST(-1 AS BIGINT) n, CAST(0 AS BIGINT) piece, 0.0::DOUBLE run, CAST(0 AS BIGINT) np FROM (SELECT DISTINCT route_id FROM s)
 UNION ALL SELECT s.route_id, s.seg_idx, np, CASE WHEN run+seg_m>=300 THEN 0 ELSE run+seg_m END, CASE WHEN run+seg_m>=300 THEN np+1 ELSE np END
 FROM st JOIN s ON s.route_id=st.route_id AND s.seg_idx=st.n+1)
SELECT route_id, n AS seg_idx, piece FROM st WHERE n>=0""")
def w9(spark, sf):
    v = view(spark, sf, "fx_route_vertices")
    return tiles.split_by_length(v, chunk_m=300.0)


@query("P13_P15_scene_guards", f"""{cte('fx_route_vertices')}, s AS (SELECT route_id, sum(seg_m)*200 m, count(*)*2 n FROM ({S.segments()}) GROUP BY 1)
SELECT route_id, CASE WHEN m>250000 THEN 'ROUTE_TOO_LONG' WHEN n*40>256 THEN 'SCENE_TILE_LIMIT_EXCEEDED' END AS precomputed,
 CASE WHEN m>250000 THEN 'ROUTE_TOO_LONG' WHEN (m/1000>100 AND n>8) OR m/1000>400 THEN 'TOO_MANY_TILES' END AS live,
 CASE route_id%7 WHEN 0 THEN 'GIVEN' WHEN 1 THEN 'SCENE_REQUEST_ABORTED' WHEN 2 THEN 'DEM_FAILURE' WHEN 3 THEN 'SCENE_PACK_DOWNLOAD_TIMEOUT' WHEN 4 THEN 'ROUTE_TOO_LONG' WHEN 5 THEN 'SCENE_PACK_CHECKSUM_FAILURE' ELSE 'SCENE_DECOMPRESS_FAILURE' END AS reason FROM s""")
def p13(spark, sf):
    s = paths.route_segments(view(spark, sf, "fx_route_vertices")).groupBy("route_id").agg(
        (F.sum("seg_m") * 200).alias("m"), (F.count("*") * 2).alias("n"))
    text = F.element_at(F.array(*[F.lit(t) for t in ("x", "request cancelled", "DEM timeout", "timeout", "bbox too big", "bad Checksum", "worker died")]),
                        (F.col("route_id") % 7 + 1).cast("int"))
    code = F.when(F.col("route_id") % 7 == 0, " GIVEN ")
    zero = F.lit(0.0)
    return s.select("route_id", tiles.precomputed_guard("m", F.col("n") * 40).alias("precomputed"),
                    tiles.scene_guard("m", zero, zero, zero, zero, F.col("m") / 1000, "n").alias("live"),
                    tiles.reason_code(code, text).alias("reason"))


@query("A16_download_cost", f"""{cte('fx_route_vertices', 'fx_tiles')},
b AS (SELECT DISTINCT route_id, CAST(floor(radians(lng+120)*6371000*cos(radians(35))/5000) AS BIGINT)%38 bx, CAST(floor(radians(lat-30)*6371000/5000) AS BIGINT)%36 by_ FROM fx_route_vertices),
n AS (SELECT DISTINCT route_id, bx+i tx, by_+j ty FROM b, (VALUES (-1),(0),(1)) a(i), (VALUES (-1),(0),(1)) c(j)),
p AS (SELECT tx, ty, tx//4*100+ty//4 pack FROM fx_tiles), k AS (SELECT pack, CAST(sum(zip_bytes) AS BIGINT) bytes FROM p JOIN fx_tiles USING (tx,ty) GROUP BY 1),
f AS (SELECT n.*, pack FROM n LEFT JOIN p USING (tx,ty)), d AS (SELECT DISTINCT route_id, pack FROM f WHERE pack IS NOT NULL)
SELECT route_id, (SELECT count(*) FROM b WHERE b.route_id=f.route_id) AS base_tiles, count(*) AS tile_count, count(*) FILTER (WHERE pack IS NULL) AS missing_tiles,
 (SELECT count(*) FROM d WHERE d.route_id=f.route_id) AS pack_count, coalesce((SELECT CAST(sum(bytes) AS BIGINT) FROM d JOIN k USING (pack) WHERE d.route_id=f.route_id),0) AS download_bytes FROM f GROUP BY 1""")
def a16(spark, sf):
    v = view(spark, sf, "fx_route_vertices")
    x, y = geo.project("lat", "lng", 30.0, -120.0, geo.math.cos(35 * geo.RAD))
    lat, lng = geo.unproject((F.floor(x / 5000) % 38 + 0.5) * 5000, (F.floor(y / 5000) % 36 + 0.5) * 5000, 30.0, -120.0, geo.math.cos(35 * geo.RAD))
    folded = v.select("route_id", lat.alias("lat"), lng.alias("lng"))
    t = view(spark, sf, "fx_tiles").withColumn("pack", F.floor(F.col("tx") / 4) * 100 + F.floor(F.col("ty") / 4))
    packs = t.groupBy("pack").agg(F.sum("zip_bytes").alias("bytes"))
    return tiles.download_cost(folded, t, packs, grid=(30.0, -120.0, geo.math.cos(35 * geo.RAD))).select(
        "route_id", "base_tiles", "tile_count", "missing_tiles", "pack_count", "download_bytes")


# -- occlusion in one plane --------------------------------------------------

# Fixed value: how far a segment's midpoint may lie from the sample that gives its height.
ELEVATION_M = 500.0

PLANE = cte("fx_terrain", "fx_buildings", "fx_ray_points")
BUILT = """h AS (SELECT *, CASE tag_height WHEN '12 m' THEN 12.0 WHEN '30 ft' THEN 9.144 END::DOUBLE th, CAST(tag_levels AS DOUBLE) lv,
 coalesce(CASE WHEN tag_min_height IS NOT NULL THEN 12 END,round(CAST(tag_min_level AS DOUBLE)*3,3),0)::DOUBLE ml, coalesce(CASE WHEN tag_min_height IS NOT NULL THEN 12 END,round(CAST(tag_min_level AS DOUBLE)*4.5,3),0)::DOUBLE mu FROM fx_buildings),
b AS (SELECT building_id, cx, cy, half_m, coalesce(th,ml+coalesce(lv*3,3)) hl, coalesce(th,mu+coalesce(lv*4.5,12)) hu, ml mlr, mu mur FROM h),
gr AS (SELECT building_id, arg_min(elevation, sqrt((cx-x)*(cx-x)+(cy-y)*(cy-y))*1000000+sample_id) ground FROM b JOIN fx_terrain ON abs(cx-x)<=500 AND abs(cy-y)<=500 AND sqrt((cx-x)*(cx-x)+(cy-y)*(cy-y))<=500 GROUP BY 1),
bb AS (SELECT b.* REPLACE (least(mlr,hl) AS mlr, least(mur,hu) AS mur), ground FROM b LEFT JOIN gr USING (building_id)),
ry AS (SELECT *, sin(radians(sun_azimuth)) dx, cos(radians(sun_azimuth)) dy FROM fx_ray_points),
ed AS (SELECT point_id, building_id, x, y, dx, dy, abs(x-cx)<half_m AND abs(y-cy)<half_m ins, cx+ax*half_m ax, cy+ay*half_m ay, (bx-ax)*half_m sx, (by_-ay)*half_m sy
 FROM ry, bb, (VALUES (-1,-1,1,-1),(1,-1,1,1),(1,1,-1,1),(-1,1,-1,-1)) q(ax,ay,bx,by_)),
ht AS (SELECT point_id, building_id, CASE WHEN bool_or(ins) THEN 0 ELSE min(t) FILTER (WHERE abs(det)>=1e-9 AND t>=0 AND u>=0 AND u<=1 AND t<=4500) END hit_m
 FROM (SELECT *, ((ax-x)*sy-(ay-y)*sx)/nullif(det,0) t, ((ax-x)*dy-(ay-y)*dx)/nullif(det,0) u FROM (SELECT *, dx*sy-dy*sx det FROM ed)) GROUP BY ALL)"""
ROAD = """rz AS (SELECT point_id, arg_min(elevation, sqrt((p.x-s.x)*(p.x-s.x)+(p.y-s.y)*(p.y-s.y))*1000000+sample_id) road_z FROM fx_ray_points p, fx_terrain s GROUP BY 1)"""
PROBE = """pb AS (SELECT point_id, road_z, sun_altitude, m, x+dx*m px, y+dy*m py FROM ry LEFT JOIN rz USING (point_id), (VALUES (250.0::DOUBLE),(600),(1200),(2400)) t(m)),
pe AS (SELECT point_id, m, arg_min(elevation, sqrt((px-x)*(px-x)+(py-y)*(py-y))*1000000+sample_id) el FROM pb JOIN fx_terrain ON sqrt((px-x)*(px-x)+(py-y)*(py-y))<=180 GROUP BY ALL),
tc AS (SELECT pb.point_id, max(road_z) rz, max(el-(road_z+tan(radians(sun_altitude))*pb.m)) cl, count(el)=4 full_ FROM pb LEFT JOIN pe ON pe.point_id=pb.point_id AND pe.m=pb.m GROUP BY 1),
te AS (SELECT point_id, full_, CASE WHEN rz IS NOT NULL THEN cl END cl, CASE WHEN rz IS NULL THEN 'clear' WHEN cl IS NULL THEN 'unknown' WHEN cl>2 THEN 'blocked' WHEN cl>=-2 THEN 'uncertain' ELSE 'clear' END st FROM tc)"""


def _buildings(spark, sf):
    b = osm.with_height_model(view(spark, sf, "fx_buildings"), "tag_height", "tag_levels", "tag_min_height", "tag_min_level")
    b = occlusion.with_bounds(b.withColumn("polygon", occlusion.square("cx", "cy", "half_m")))
    near = nearest_of_places(b.select("building_id", F.col("cx").alias("x"), F.col("cy").alias("y")), view(spark, sf, "fx_terrain"),
                             500.0, "building_id", keep=["elevation"])
    return b.join(near.select("building_id", F.col("elevation").alias("ground")), "building_id", "left").withColumn(
        "ground_error_m", F.lit(2.0))


@query("J5_building_ground", f"{PLANE}, {BUILT} SELECT building_id, ground FROM bb")
def j5(spark, sf):
    return _buildings(spark, sf).select("building_id", "ground")


@query("J4_nearest_sample", f"""{PLANE},
d AS (SELECT point_id, sample_id, sqrt((p.x*1.7-s.x)*(p.x*1.7-s.x)+(p.y*1.7-s.y)*(p.y*1.7-s.y)) m FROM fx_ray_points p, fx_terrain s)
SELECT point_id, sample_id, round(m,6) AS distance FROM d QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY m, sample_id)=1""")
def j4(spark, sf):
    p = view(spark, sf, "fx_ray_points").select("point_id", (F.col("x") * 1.7).alias("x"), (F.col("y") * 1.7).alias("y"))
    return rounded(nearest_any(p, view(spark, sf, "fx_terrain")), 6, "distance").select("point_id", "sample_id", "distance")


@query("J31_segment_elevation", f"""{PLANE}, mp AS (SELECT point_id, x+60 mx, y-45 my FROM fx_ray_points),
rz AS (SELECT point_id, arg_min(elevation, sqrt((mx-x)*(mx-x)+(my-y)*(my-y))*1000000+sample_id) road_z FROM mp JOIN fx_terrain ON sqrt((mx-x)*(mx-x)+(my-y)*(my-y))<=500 GROUP BY 1)
SELECT point_id, road_z AS elevation_m, round(100*pow((44331.514::DOUBLE-coalesce(road_z,0))/11880.516,1/0.1902632::DOUBLE),3) AS pressure_pa FROM fx_ray_points LEFT JOIN rz USING (point_id)""")
def j31(spark, sf):
    """Segments of 120 m by -90 m begin at the ray points; the sample nearest to the midpoint counts."""
    p = view(spark, sf, "fx_ray_points").withColumns({"x2": F.col("x") + 120, "y2": F.col("y") - 90})
    middle = p.withColumns({"x": (F.col("x") + F.col("x2")) / 2, "y": (F.col("y") + F.col("y2")) / 2})
    near = nearest_within(middle, view(spark, sf, "fx_terrain"), ELEVATION_M, keep=["elevation"])
    out = p.join(near, "point_id", "left").select("point_id", F.col("elevation").alias("elevation_m"),
                                                  solar.pressure_pa("elevation").alias("pressure_pa"))
    return rounded(out, 3, "pressure_pa")


@query("J7_F8_F9_ray_hits", f"{PLANE}, {BUILT} SELECT point_id, building_id, round(hit_m,5) AS hit_m FROM ht WHERE hit_m IS NOT NULL")
def j7(spark, sf):
    hits = occlusion.ray_hits(occlusion.with_ray(view(spark, sf, "fx_ray_points")), _buildings(spark, sf))
    return rounded(hits, 5, "hit_m").select("point_id", "building_id", "hit_m")


VERDICT = """hv AS (SELECT point_id, building_id, ground+hl-(z+2) lo, ground+hu-z+2 hi, z>=ground+mur+2-1.5 rb, z>=ground+mlr-2-1.5 pbm FROM
 (SELECT ht.*, hl, hu, mlr, mur, ground, coalesce(road_z,ground)+tan(radians(sun_altitude))*hit_m z FROM ht JOIN bb USING (building_id) JOIN ry USING (point_id) LEFT JOIN rz USING (point_id) WHERE hit_m IS NOT NULL AND ground IS NOT NULL)),
bv AS (SELECT point_id, bool_or(rb AND lo>=1.5) bl, bool_or(pbm AND hi>=-1.5 AND NOT (rb AND lo>=1.5)) un, max(lo) mg FROM hv GROUP BY 1)"""


@query("J8_A9_building_verdict", f"""{PLANE}, {BUILT}, {ROAD}, {VERDICT}
SELECT point_id, bl AS building_blocked, un AS building_uncertain, round(mg,4) AS building_margin_m FROM bv""")
def j8(spark, sf):
    out = _planar(spark, sf).filter(F.col("building_margin_m").isNotNull())
    return rounded(out, 4, "building_margin_m").select("point_id", "building_blocked", "building_uncertain", "building_margin_m")


def _planar(spark, sf):
    return occlusion.planar_occlusion(view(spark, sf, "fx_ray_points"), _buildings(spark, sf), view(spark, sf, "fx_terrain"))


@query("A8_D5_terrain_verdict", f"""{PLANE}, {BUILT}, {ROAD}, {PROBE}
SELECT point_id, round(cl,4) AS clearance_m, st AS terrain_state FROM te""")
def a8(spark, sf):
    p = view(spark, sf, "fx_ray_points")
    s = view(spark, sf, "fx_terrain")
    road = nearest_any(p, s, keep=["elevation"]).select("point_id", F.col("elevation").alias("road_z"))
    probes = occlusion.terrain_probes(occlusion.with_ray(p).join(road, "point_id", "left"), s)
    return rounded(occlusion.terrain_verdict(probes), 4, "clearance_m").select("point_id", "clearance_m", "terrain_state")


@query("A10_D6_occlusion_verdict", f"""{PLANE}, {BUILT}, {ROAD}, {PROBE}, {VERDICT},
v AS (SELECT point_id, coalesce(bl,false) bl, coalesce(un,false) un, CASE WHEN full_ THEN st END st FROM fx_ray_points LEFT JOIN bv USING (point_id) LEFT JOIN te USING (point_id))
SELECT point_id, CASE WHEN bl OR st='blocked' THEN 1.0 WHEN un OR st IN ('uncertain','unknown') THEN NULL ELSE 0 END::DOUBLE AS occlusion,
 CASE WHEN bl OR st='blocked' THEN 'confirmed-shade' WHEN un OR st IN ('uncertain','unknown') THEN 'uncertain' ELSE 'confirmed-clear' END AS shade_state,
 CASE WHEN bl AND st='blocked' THEN 'building+terrain' WHEN bl THEN 'building' WHEN st='blocked' THEN 'terrain' WHEN un OR st IN ('uncertain','unknown') THEN 'scene-uncertain' ELSE 'scene-clear' END AS source FROM v""")
def a10(spark, sf):
    return _planar(spark, sf).select("point_id", "occlusion", "shade_state", "source")


@query("P14_near_route", f"""{PLANE}, e AS (SELECT min(x) a, max(x)*0.2 b, min(y) c, max(y)*0.2 d FROM fx_ray_points)
SELECT building_id FROM fx_buildings, e WHERE sqrt(pow(greatest(cx-half_m-b,a-cx-half_m,0),2)+pow(greatest(cy-half_m-d,c-cy-half_m,0),2))<=2000""")
def p14(spark, sf):
    ends = view(spark, sf, "fx_ray_points").agg(F.struct(F.min("x").alias("a"), (F.max("x") * 0.2).alias("b"), F.min("y").alias("c"),
                                                         (F.max("y") * 0.2).alias("d")).alias("e")).scalar()
    b = settled(view(spark, sf, "fx_buildings"), "_e", ends)  # one look-up of the row, not one per field
    b = occlusion.with_bounds(b.withColumn("polygon", occlusion.square("cx", "cy", "half_m")))
    gap = tiles.box_gap_m(("min_x", "max_x", "min_y", "max_y"), ("_e.a", "_e.b", "_e.c", "_e.d"))
    return b.filter(gap <= 2000).select("building_id")


@query("J9_F10_near_tunnel", f"""{PLANE},
t AS (SELECT building_id tid, cx ax, cy ay, cx+half_m*10 bx, cy+half_m*4 by_ FROM fx_buildings),
e AS (SELECT point_id, x, y FROM fx_ray_points UNION ALL SELECT point_id, x+40, y+25 FROM fx_ray_points),
f AS (SELECT point_id, x, y, ax, ay, bx-ax dx, by_-ay dy, greatest(0,least(1,((x-ax)*(bx-ax)+(y-ay)*(by_-ay))/((bx-ax)*(bx-ax)+(by_-ay)*(by_-ay)))) k FROM e, t)
SELECT DISTINCT point_id FROM f WHERE sqrt(pow(x-ax-dx*k,2)+pow(y-ay-dy*k,2))<14""")
def j9(spark, sf):
    t = view(spark, sf, "fx_buildings").select(F.col("cx").alias("ax"), F.col("cy").alias("ay"), (F.col("cx") + F.col("half_m") * 10).alias("bx"),
                                               (F.col("cy") + F.col("half_m") * 4).alias("by_"))
    p = view(spark, sf, "fx_ray_points").withColumns({"x2": F.col("x") + 40, "y2": F.col("y") + 25})
    return occlusion.near_tunnel(p, t)


@query("J10_best_profile", f"""{PLANE},
p AS (SELECT point_id, point_id//24 rid, x, y, sun_azimuth, point_id%40 seg_idx FROM fx_ray_points),
f AS (SELECT point_id//24 rid, point_id%24 pi, x px, y py, fmod(sun_azimuth+90,360) direction, point_id%24*2 vi FROM fx_ray_points WHERE point_id%7<>0)
SELECT point_id, pi AS profile_idx, round(sqrt((x-px)*(x-px)+(y-py)*(y-py))/1000+{S.angle('direction', 'sun_azimuth')}/90+abs(vi-seg_idx)/10.0::DOUBLE,6) AS profile_score
FROM p JOIN f USING (rid) QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY sqrt((x-px)*(x-px)+(y-py)*(y-py))/1000+{S.angle('direction', 'sun_azimuth')}/90+abs(vi-seg_idx)/10.0::DOUBLE, pi)=1""")
def j10(spark, sf):
    k = F.col("point_id")
    r = view(spark, sf, "fx_ray_points")
    p = r.select("point_id", F.floor(k / 24).alias("route_id"), "x", "y", "sun_azimuth", (k % 40).alias("seg_idx"))
    f = r.select(F.floor(k / 24).alias("route_id"), (k % 24).alias("profile_idx"), (k % 24 * 2).alias("v_idx"), F.col("x").alias("px"),
                 F.col("y").alias("py"), ((F.col("sun_azimuth") + 90) % 360).alias("direction"), (k % 7 != 0).alias("complete"))
    out = occlusion.best_profile(p, f).filter(F.col("profile_idx").isNotNull())
    return rounded(out, 6, "profile_score").select("point_id", "profile_idx", "profile_score")
