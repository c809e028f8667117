"""Landed formats: each query lets Spark write the format from the tables and reads it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo, keys
from ..functions.sql import register_functions
from ..operators import packs as pk
from ..operators.spatial import nearest_segment
from ..operators import paths, resample
from ..operators.destinations import trim_to_road
from ..sources import files
from ..sources.redaction import redact_props, sanitize_json
from ..session import cut_lineage, shared_folder
from . import sqltext as S
from .registry import query, rounded
from .views import cte, table, view

VERTS = cte("fx_route_vertices")
STEPS = cte("fx_route_vertices", "fx_steps")


def _responses(spark, sf):
    """One routing response per route, two legs' worth of steps in one leg."""
    v = view(spark, sf, "fx_route_vertices")
    s = view(spark, sf, "fx_steps").join(v.withColumnRenamed("v_idx", "step_idx"), ["route_id", "step_idx"])
    k = F.col("route_id") + F.col("step_idx")
    step = F.struct(
        "distance", "duration", F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("road "), (k % 5).cast("string"))).alias("name"),
        F.lit("A1").alias("ref"), (k % 17 == 0).alias("toll"), F.when(k % 19 == 0, F.array(F.lit("toll"))).otherwise(F.array(F.lit("motorway"))).alias("classes"),
        F.array(F.struct(F.when(k % 23 == 0, F.array(F.lit("Tunnel_x"))).otherwise(F.array().cast("array<string>")).alias("classes"))).alias("intersections"),
        F.struct(F.when(F.col("step_idx") == 0, "depart").otherwise("turn").alias("type"), F.lit("left").alias("modifier"),
                 F.array("lng", "lat").alias("location"), F.lit(1.0).alias("bearing_before"), F.lit(2.0).alias("bearing_after")).alias("maneuver"),
        F.struct(F.array(F.array("lng", "lat")).alias("coordinates")).alias("geometry"))
    # A fixture response is one document per route, as a routing service sends it.
    lines = v.groupBy("route_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("v_idx", "lng", "lat"))),
                                                  lambda p: F.array(p["lng"], p["lat"])).alias("coordinates"))
    legs = s.withColumn("step", step).groupBy("route_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("step_idx", F.to_json("step").alias("j")))), lambda x: x["j"]).alias("steps"),
        F.sum("distance").alias("distance"), F.sum("duration").alias("duration"))
    both = lines.join(legs, "route_id")
    text = F.concat(F.lit('{"routes":[{"distance":'), F.col("distance").cast("string"), F.lit(',"duration":'), F.col("duration").cast("string"),
                    F.lit(',"geometry":'), F.to_json(F.struct("coordinates")), F.lit(',"legs":[{"steps":['), F.array_join("steps", ","),
                    F.lit(']}]}],"waypoints":[{"location":'), F.to_json(F.element_at("coordinates", -1)), F.lit("}]}"))
    return both.select(F.col("route_id").alias("od_id"), text.alias("response"))


def _read(spark, sf):
    return files.route_candidates(_responses(spark, sf)).withColumnRenamed("od_id", "route_id")


@query("S1_P1_read_routes", f"""{VERTS} SELECT route_id, v_idx, lat, lng FROM fx_route_vertices""")
def s1(spark, sf):
    return files.route_vertices(_read(spark, sf), ["route_id"])


@query("P2_toll_routes", f"""{STEPS} SELECT route_id, bool_or((route_id+step_idx)%17=0 OR (route_id+step_idx)%19=0) AS has_toll FROM fx_steps GROUP BY 1""")
def p2(spark, sf):
    return _read(spark, sf).select("route_id", files.route_has_toll().alias("has_toll"))


@query("P10_tunnel_steps", f"""{STEPS} SELECT route_id, step_idx FROM fx_steps WHERE (route_id+step_idx)%23=0""")
def p10(spark, sf):
    return files.route_steps(_read(spark, sf), ["route_id"]).filter(files.step_is_tunnel()).select("route_id", "step_idx")


@query("P11_maneuvers", f"""{STEPS},
c AS (SELECT route_id, step_idx, sum(distance) OVER (PARTITION BY route_id ORDER BY step_idx)-distance AS cumulative_m FROM fx_steps)
SELECT c.route_id, step_idx, cumulative_m, lat, lng FROM c JOIN fx_route_vertices v ON v.route_id=c.route_id AND v_idx=step_idx WHERE step_idx>0""")
def p11(spark, sf):
    m = files.maneuvers(files.route_steps(_read(spark, sf), ["route_id"]))
    return m.select("route_id", "step_idx", "cumulative_m", "lat", "lng")


@query("J28_W11_anchored_geometry")
def j28(spark, sf):
    run = cut_lineage(paths.with_running_m(paths.route_segments(view(spark, sf, "fx_route_vertices"))))
    steps = files.route_steps(_read(spark, sf), ["route_id"])
    tagged = F.struct("route_id", "step_idx", files.step_is_tunnel().alias("is_tunnel")).alias("point_id")
    spot = steps.select(tagged, "route_id", F.get("maneuver.location", F.lit(1)).alias("lat"), F.get("maneuver.location", F.lit(0)).alias("lng"))
    near = nearest_segment(spot, run, carry=["start_m", "seg_m"])
    anchors = near.select("point_id.*", (F.col("start_m") + F.col("seg_m") * F.col("t")).alias("anchor_m"))
    return rounded(resample.sample_distances(run, anchors, stored=True), 3, "target_m")


@query("P18_road_destination", f"""{STEPS},
s AS (SELECT f.route_id, step_idx, distance, duration, (f.route_id+step_idx)%3<>0 nm, lat, lng FROM fx_steps f JOIN fx_route_vertices v ON v.route_id=f.route_id AND v_idx=step_idx),
m AS (SELECT route_id, max(step_idx) FILTER (WHERE nm) k, max(step_idx) l, sum(distance) d, sum(duration) t FROM s GROUP BY 1),
c AS (SELECT m.*, {S.hav('a.lat', 'a.lng', 'b.lat', 'b.lng')} gap, a.lat, a.lng FROM m LEFT JOIN s a ON a.route_id=m.route_id AND a.step_idx=k LEFT JOIN s b ON b.route_id=m.route_id AND b.step_idx=l),
q AS (SELECT c.route_id, coalesce(l>k AND gap<=300,false) trimmed, d, t, l, (SELECT max(v_idx) FROM fx_route_vertices v WHERE v.route_id=c.route_id AND v.lat=c.lat AND v.lng=c.lng) w,
 (SELECT sum(distance) FROM s WHERE s.route_id=c.route_id AND step_idx>k) rd, (SELECT sum(duration) FROM s WHERE s.route_id=c.route_id AND step_idx>k) rt FROM c)
SELECT route_id, trimmed, round(CASE WHEN trimmed THEN greatest(0,d-rd) ELSE d END,3) AS distance, round(CASE WHEN trimmed THEN greatest(0,t-rt) ELSE t END,3) AS duration,
 CAST(CASE WHEN trimmed THEN w+1 ELSE l+1 END AS INTEGER) AS points FROM q""")
def p18(spark, sf):
    return trim_to_road(_read(spark, sf)).select("route_id", "trimmed", F.round("distance", 3).alias("distance"),
                                                 F.round("duration", 3).alias("duration"), F.size("geometry.coordinates").alias("points"))


@query("S2_route_formats", f"""{VERTS} SELECT route_id, count(*) AS points, round(sum(lng),6) AS lng_sum, round(sum(lat),6) AS lat_sum FROM fx_route_vertices GROUP BY 1""")
def s2(spark, sf):
    line = F.transform(F.sort_array(F.collect_list(F.struct("v_idx", "lng", "lat"))), lambda p: F.array(p["lng"], p["lat"]))
    v = view(spark, sf, "fx_route_vertices").groupBy("route_id").agg(F.to_json(line).alias("c"), F.to_json(F.transform(
        line, lambda p: F.struct(p.alias("value")))).alias("w"))
    put = lambda a, b: F.concat(F.lit(a), F.col("c"), F.lit(b))
    shape = F.col("route_id") % 5
    text = (F.when(shape == 0, F.col("c")).when(shape == 1, F.col("w")).when(shape == 2, put('{"type":"LineString","coordinates":', "}"))
            .when(shape == 3, put('{"type":"Feature","geometry":{"type":"LineString","coordinates":', "}}"))
            .otherwise(put('{"routes":[{"geometry":{"coordinates":', "}}]}")))
    c = v.select("route_id", files.any_route_coordinates(text).alias("c"))
    total = lambda i: F.round(F.aggregate(F.transform("c", lambda p: p[i]), F.lit(0.0), lambda a, b: a + b), 6)
    return c.select("route_id", F.size("c").cast("long").alias("points"), total(0).alias("lng_sum"), total(1).alias("lat_sum"))


@query("S3_T8_manifest_tiles", f"""{cte('fx_tiles')} SELECT tx, ty, concat('t_',tx,'_',ty,'.json') AS file, zip_bytes AS bytes,
 CASE WHEN tile_no%2=0 THEN concat('p',tx%4) END AS pack FROM fx_tiles""")
def s3(spark, sf):
    t = view(spark, sf, "fx_tiles").withColumns({"key": geo.tile_key("tx", "ty"), "file": F.format_string("t_%d_%d.json", "tx", "ty")})
    even = F.col("tile_no") % 2 == 0
    loose = t.filter(~even).select(F.to_json(F.struct(F.array(F.struct("key", F.concat(F.lit("./"), "file").alias("path"), F.col("zip_bytes").alias("bytes"))).alias("tiles"))).alias("m"))
    packed = t.filter(even).select(F.to_json(F.struct(F.create_map("key", F.struct(
        "file", F.concat(F.lit("p"), (F.col("tx") % 4).cast("string")).alias("pack"), F.col("zip_bytes").alias("bytes"))).alias("tiles"))).alias("m"))
    rows = loose.union(packed).select(F.explode(files.manifest_tiles("m")).alias("t")).select("t.*")
    tx, ty = geo.parse_tile_key("key")
    return rows.select(tx.alias("tx"), ty.alias("ty"), keys.safe_relative_path("file").alias("file"), "bytes", "pack")


@query("S10_map_elements", f"""{cte('fx_buildings')}, e AS (SELECT building_id%97 id, building_id pos, half_m FROM fx_buildings)
SELECT id, arg_min(half_m,pos) AS half FROM e GROUP BY 1""")
def s10(spark, sf):
    b = view(spark, sf, "fx_buildings")
    corner = lambda i, j: F.struct((F.lit(42.0) + i * F.col("half_m")).alias("lat"), (F.lit(-71.0) + j * F.col("half_m")).alias("lon"))
    element = F.struct(F.lit("way").alias("type"), (F.col("building_id") % 97).alias("id"), F.create_map(F.lit("building"), F.lit("yes")).alias("tags"),
                       F.array(corner(0, 0), corner(0, 1), corner(1, 1)).alias("geometry"))
    doc = b.select(F.col("building_id").alias("batch"), F.to_json(F.struct(F.array(element).alias("elements"))).alias("response"))
    found = files.buildings_of(files.map_elements(doc, keep=["batch"]), ["batch", "pos"])
    return found.select("id", (F.element_at("points", -1)["lat"] - 42.0).alias("half"))


@query("S11_elevation_answers", f"""{cte('fx_terrain')} SELECT sample_id, CASE WHEN sample_id%13<>0 THEN elevation END AS elevation FROM fx_terrain""")
def s11(spark, sf):
    t = view(spark, sf, "fx_terrain").withColumns({"batch_id": F.floor(F.col("sample_id") / 80), "pos": (F.col("sample_id") % 80).cast("int")})
    answer = F.struct(F.when(F.col("sample_id") % 13 != 0, F.col("elevation")).alias("elevation"))
    # A batch holds 80 points, the size of one elevation request.
    r = t.groupBy("batch_id").agg(F.sort_array(F.collect_list(F.struct("pos", answer.alias("a")))).alias("l"))
    low = F.array_min(F.transform("l", lambda x: x["pos"]))
    filled = F.transform(F.sequence(F.lit(0), F.array_max(F.transform("l", lambda x: x["pos"]))), lambda i: F.get(F.transform(F.filter(
        "l", lambda x: x["pos"] == i), lambda x: x["a"]), F.lit(0)))
    r = r.select("batch_id", F.to_json(F.struct(filled.alias("results")), {"ignoreNullFields": "false"}).alias("response"))
    out = files.elevation_answers(t.select("batch_id", "pos", F.col("sample_id").alias("key")), r)
    return out.select(F.col("key").alias("sample_id"), "elevation")


@query("S12_place_formats", f"""{cte('fx_place_results')}
SELECT result_id, source, CASE WHEN source='photon' THEN concat(display_name,', Town, USA') ELSE display_name END AS display_name,
 CASE WHEN source='photon' THEN display_name ELSE concat(house_number,' Road') END AS short_title, lat, lng, CAST(house_number AS VARCHAR) AS house_number FROM fx_place_results""")
def s12(spark, sf):
    p = view(spark, sf, "fx_place_results").withColumn("house", F.col("house_number").cast("string"))
    nom = F.to_json(F.array(F.struct(F.col("lat").cast("string").alias("lat"), F.col("lng").cast("string").alias("lon"), "display_name",
                                     F.struct(F.col("house").alias("house_number"), F.lit("Road").alias("road")).alias("address"), "importance")))
    pho = F.to_json(F.struct(F.array(F.struct(
        F.struct(F.col("display_name").alias("name"), F.lit("Town").alias("town"), F.lit("USA").alias("country"), F.col("house").alias("housenumber"), "importance").alias("properties"),
        F.struct(F.array("lng", "lat").alias("coordinates")).alias("geometry"))).alias("features")))
    raw = p.select("result_id", "source", F.when(F.col("source") == "nominatim", nom).otherwise(pho).alias("t"))
    rows = raw.select("result_id", F.explode(files.place_results("t", "source")).alias("r")).select("result_id", "r.*")
    return rows.select("result_id", "source", "display_name", "short_title", "lat", "lng", "house_number")


@query("S9_region_bounds", f"""{VERTS} SELECT route_id%7 AS region, min(lat) AS south, min(lng) AS west, max(lat) AS north, max(lng) AS east FROM fx_route_vertices GROUP BY 1""")
def s9(spark, sf):
    v = view(spark, sf, "fx_route_vertices")
    text = F.when(F.col("v_idx") == 0, F.array(F.lit("outline"), F.lit("END"))).otherwise(F.array())
    line = F.concat(F.lit("   "), F.col("lng").cast("string"), F.lit("   "), F.col("lat").cast("string"))
    lines = v.select((F.col("route_id") % 7).alias("region"), F.explode(F.concat(text.cast("array<string>"), F.array(line))).alias("value"))
    return files.region_bounds(lines)


@query("F38_safe_paths", f"""{cte('fx_tiles')} SELECT tile_no, CASE tile_no%5 WHEN 0 THEN concat('a/',tile_no) WHEN 1 THEN concat('b/',tile_no) WHEN 4 THEN concat('x..y/',tile_no) END AS path FROM fx_tiles""")
def f38(spark, sf):
    k = F.col("tile_no").cast("string")
    raw = F.element_at(F.array(*[F.concat(F.lit(p), k) for p in ("a/", ".\\b\\", "../", "/abs/", "x..y/")]), (F.col("tile_no") % 5 + 1).cast("int"))
    return view(spark, sf, "fx_tiles").select("tile_no", keys.safe_relative_path(raw).alias("path"))


@query("F37_redacted_props", """SELECT event_id, CASE WHEN event_id%3=0 THEN NULL ELSE CAST(json_extract(props,'$.k') AS BIGINT) END AS k, round(event_id/7.0::DOUBLE,3) AS lat, 300+1 AS note_chars FROM events""")
def f37(spark, sf):
    e = table(spark, sf, "events")
    name = F.when(F.col("event_id") % 3 == 0, "apiToken").otherwise("k")
    props = F.from_json("props", "map<string,bigint>")
    m = F.map_from_arrays(F.array(name, F.lit("note")), F.array(props["k"].cast("string"), F.repeat(F.lit("x"), 400)))
    out = e.select("event_id", redact_props(m).alias("p"), geo.half_up(F.col("event_id") / 7.0, 3).alias("lat"))
    return out.select("event_id", F.col("p")["k"].cast("long").alias("k"), "lat", F.length(F.col("p")["note"]).alias("note_chars"))


@query("F37_deep_json")
def f37b(spark, sf):
    e = table(spark, sf, "events")
    text = F.concat(F.lit('{"position":{"lat":'), (F.col("event_id") / 7.0).cast("string"), F.lit(',"lng":1.23456},"auth_token":"s","deep":{"a":{"b":{"c":{"d":1}}}},"p":'), "props", F.lit("}"))
    return e.select("event_id", sanitize_json(text).alias("safe"))


@query("D8_A19_group_relations", f"""{cte('fx_tiles')},
g AS (SELECT tx//8 sx, ty//8 sy, min(tx) a, min(ty) b, max(tx) c, max(ty) d, count(*) n, sum(zip_bytes)+22 bytes, sha256(string_agg(concat(tx,':',ty),'|' ORDER BY tx,ty)) h FROM fx_tiles GROUP BY ALL)
SELECT l.sx, l.sy, l.n AS tiles, CAST(l.bytes AS BIGINT) AS bytes, concat(l.a,'_',l.b,'-',l.c,'_',l.d,'-',substr(l.h,1,10)) AS pack,
 CASE WHEN r.sx IS NOT NULL THEN round(sqrt(pow(greatest(0,l.a-r.c-1,r.a-l.c-1),2)+pow(greatest(0,l.b-r.d-1,r.b-l.d-1),2)),6) END AS gap,
 CASE WHEN r.sx IS NOT NULL THEN greatest(l.c,r.c)-least(l.a,r.a)+1 END AS span_x, CASE WHEN r.sx IS NOT NULL THEN greatest(l.d,r.d)-least(l.b,r.b)+1 END AS span_y
FROM g l LEFT JOIN g r ON r.sx=l.sx+1 AND r.sy=l.sy""")
def d8(spark, sf):
    t = view(spark, sf, "fx_tiles")
    a = t.select("tx", "ty", "zip_bytes", F.floor(F.col("tx") / 8).alias("seed_x"), F.floor(F.col("ty") / 8).alias("seed_y"), F.lit(0).alias("pack_no"), F.lit(False).alias("dense"))
    g = pk.pack_table(a)
    r = g.select((F.col("seed_x") - 1).alias("seed_x"), "seed_y", *[F.col(c).alias(f"r_{c}") for c in ("min_x", "min_y", "max_x", "max_y")])
    gap, sx, sy = pk.group_relation(("min_x", "min_y", "max_x", "max_y"), ("r_min_x", "r_min_y", "r_max_x", "r_max_y"))
    both = g.join(r, ["seed_x", "seed_y"], "left")
    known = F.col("r_min_x").isNotNull()
    return both.select(F.col("seed_x").alias("sx"), F.col("seed_y").alias("sy"), "tiles", "bytes", "pack", F.when(known, F.round(gap, 6)).alias("gap"),
                       F.when(known, sx).alias("span_x"), F.when(known, sy).alias("span_y"))


@query("D7_D9_packs")
def d7(spark, sf):
    a = pk.assign_packs(view(spark, sf, "fx_tiles"))
    return pk.manifest(a, pk.pack_table(a), {"schema": "3", "tile_m": "5000"})


@query("X4_packed_once", f"{cte('fx_tiles')} SELECT count(*) AS tiles, 0 AS wrong FROM fx_tiles")
def x4(spark, sf):
    t = view(spark, sf, "fx_tiles")
    a = pk.assign_packs(t)
    wrong = pk.coverage_check(t, a).agg(F.count("*")).scalar()
    return a.agg(F.count("*").alias("tiles")).withColumn("wrong", wrong)


@query("A7_pack_stats", f"""{cte('fx_tiles')}, s AS (SELECT zip_bytes v, row_number() OVER (ORDER BY zip_bytes)-1 i, count(*) OVER () n FROM fx_tiles)
SELECT count(*) AS packs, CAST(sum(v) AS BIGINT) AS total_bytes, min(v) AS min_bytes, max(v) AS max_bytes, CAST(max(v) FILTER (WHERE i=floor((n-1)*0.5)) AS DOUBLE) AS p50_bytes,
 CAST(max(v) FILTER (WHERE i=floor((n-1)*0.95)) AS DOUBLE) AS p95_bytes FROM s""")
def a7(spark, sf):
    return pk.pack_stats(view(spark, sf, "fx_tiles").select(F.col("zip_bytes").alias("bytes")))


@query("J25_J26_file_differences", f"""{cte('fx_tiles')}
SELECT tx, ty, CASE WHEN tile_no%11=0 THEN 'missing' WHEN tile_no%7=0 THEN 'extra' WHEN tile_no%5=0 THEN 'repeated' ELSE 'ok' END AS state FROM fx_tiles""")
def j25(spark, sf):
    t = view(spark, sf, "fx_tiles")
    k = F.col("tile_no")
    listed = t.filter((k % 7 != 0) | (k % 11 == 0))
    copies = F.when(k % 5 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    present = t.filter(k % 11 != 0).withColumn("_n", F.explode(copies))
    return pk.file_differences(listed, present, ["tx", "ty"]).select("tx", "ty", F.when((F.col("listed") == 0) & (F.col("found") > 0), "extra").otherwise(F.col("state")).alias("state"))


@query("D10_release_check", f"""{cte('fx_tiles')}
SELECT concat('f',tile_no) AS file, CASE WHEN tile_no%11=0 THEN 'missing' WHEN tile_no%7=0 THEN 'byte count mismatch' WHEN tile_no%5=0 THEN 'checksum mismatch' WHEN zip_bytes>300000 THEN 'over hard limit' ELSE 'ok' END AS state FROM fx_tiles""")
def d10(spark, sf):
    k = F.col("tile_no")
    t = view(spark, sf, "fx_tiles").select("tile_no", F.concat(F.lit("f"), k.cast("string")).alias("file"), F.col("zip_bytes").alias("bytes"),
                                           F.sha2(k.cast("string"), 256).alias("sha256"))
    found = t.filter(k % 11 != 0).select("file", (F.col("bytes") + F.when(k % 7 == 0, 1).otherwise(0)).alias("bytes"),
                                         F.when(k % 5 == 0, "x").otherwise(F.col("sha256")).alias("sha256"))
    return pk.release_check(t.drop("tile_no"), found, hard_max=300000).select("file", "state")


@query("A15_tile_quality", f"""{cte('fx_buildings')},
b AS (SELECT building_id//10 tx, building_id%4 ty, building_id%6 id, building_id%9=0 ng, building_id%5=0 adj, building_id%8=0 bad FROM fx_buildings),
t AS (SELECT tx, ty, count(*) n, bool_or(ng) ng, count(*)-count(DISTINCT id) dup FROM b GROUP BY ALL), x AS (SELECT *, (tx+ty)%10=0 gone, (tx+ty)%10=1 extra, (tx*3+ty)%7=0 wrongf FROM t)
SELECT count(*) FILTER (WHERE NOT gone AND NOT extra) AS tiles, count(*) FILTER (WHERE gone) AS missing_files, count(*) FILTER (WHERE extra) AS extra_files,
 count(*) FILTER (WHERE NOT gone AND NOT extra AND wrongf) AS metadata_errors, CAST(sum(n) FILTER (WHERE NOT gone) AS BIGINT) AS buildings,
 (SELECT count(*) FROM b JOIN x USING (tx,ty) WHERE ng AND NOT gone) AS missing_ground, (SELECT count(*) FROM b JOIN x USING (tx,ty) WHERE adj AND NOT gone) AS adjusted_min_heights,
 (SELECT count(*) FROM b JOIN x USING (tx,ty) WHERE bad AND NOT gone) AS invalid_envelopes, CAST(sum(dup) FILTER (WHERE NOT gone) AS BIGINT) AS duplicate_ids FROM x""".replace("b JOIN x USING (tx,ty) WHERE ng AND", "b JOIN (SELECT tx,ty,gone FROM x) USING (tx,ty) WHERE b.ng AND").replace(
    "WHERE adj AND NOT gone", "WHERE adj AND NOT gone"))
def a15(spark, sf):
    k = F.col("building_id")
    b = view(spark, sf, "fx_buildings").select(
        F.floor(k / 10).alias("tx"), (k % 4).alias("ty"), (k % 6).alias("id"), F.when(k % 9 != 0, 1.0).alias("ground"), (k % 5 == 0).alias("min_height_adjusted"),
        F.when(k % 8 == 0, 1.0).otherwise(9.0).alias("height"), F.lit(9.0).alias("height_lower"), F.lit(9.0).alias("height_upper"),
        F.lit(2.0).alias("min_height"), F.lit(2.0).alias("min_height_lower"), F.lit(2.0).alias("min_height_upper"))
    t = b.groupBy("tx", "ty").agg(F.count("*").alias("buildings"), F.bool_and(F.col("ground").isNotNull()).alias("building_ground"))
    t = t.withColumns({"fingerprint": F.lit("f"), "tunnels": F.lit(1), "terrain": F.lit(1), "_k": (F.col("tx") + F.col("ty")) % 10})
    written = t.filter("_k <> 0")
    listed = t.filter("_k <> 1").withColumn("fingerprint", F.when((F.col("tx") * 3 + F.col("ty")) % 7 == 0, "g").otherwise("f"))
    inside = b.join(written.select("tx", "ty"), ["tx", "ty"], "left_semi")
    return pk.tile_quality(written, inside, listed).drop("tunnels", "terrain")


@query("S17_staged_results", f"""{cte('fx_route_candidates')}
SELECT route_id, CASE WHEN route_id%3=0 THEN 'refined' ELSE 'heuristic' END AS analysis_phase,
 round(CASE WHEN route_id%3=0 THEN shade ELSE avg_glare END,9) AS score FROM fx_route_candidates""")
def s17(spark, sf):
    """Heuristic rows of all routes first, refined ones of every third later; refined ones are written twice."""
    c = view(spark, sf, "fx_route_candidates")
    at = shared_folder(spark, "staged")
    files.write_phase(c.select("route_id", F.col("avg_glare").alias("score")), at, "heuristic")
    refined = c.filter("route_id % 3 = 0").select("route_id", F.col("shade").alias("score"))
    for batch_id in (0, 0, 1):
        files.phase_sink(at, "refined")(refined, batch_id)
    return rounded(files.latest_phase(spark, at), 9, "score").select("route_id", "analysis_phase", "score")


@query("W11_sql_resample_route", f"""{VERTS}, q AS ({S.running()}), n AS (SELECT route_id, max(total_m) tm FROM q GROUP BY 1),
p AS (SELECT route_id, tm, unnest(range(CAST(ceil(tm/60.0::DOUBLE) AS BIGINT))) k FROM n),
h AS (SELECT route_id, k, seg_idx, k*60.0::DOUBLE t, lat1+(lat2-lat1)*((k*60.0::DOUBLE-start_m)/seg_m) lat, lng1+(lng2-lng1)*((k*60.0::DOUBLE-start_m)/seg_m) lng
 FROM p JOIN q USING (route_id) WHERE end_m>k*60.0::DOUBLE QUALIFY row_number() OVER (PARTITION BY route_id, k ORDER BY seg_idx)=1),
e AS (SELECT route_id, ceil(tm/60.0::DOUBLE) k, tm t, l.lat, l.lng FROM n JOIN (SELECT route_id, arg_max(lat,v_idx) lat, arg_max(lng,v_idx) lng FROM fx_route_vertices GROUP BY 1) l USING (route_id))
SELECT route_id, CAST(k AS BIGINT) AS v_idx, round(t,3) AS target_m, round(lat,7) AS lat, round(lng,7) AS lng FROM (SELECT route_id, k, t, lat, lng FROM h UNION ALL SELECT * FROM e)""")
def w11_sql(spark, sf):
    """The table function, called from SQL for every route."""
    register_functions(spark)
    point = F.struct("v_idx", "lat", "lng")
    v = view(spark, sf, "fx_route_vertices").groupBy("route_id").agg(F.sort_array(F.collect_list(point)).alias("p"))
    v.select("route_id", F.transform("p", lambda p: F.struct(p["lat"].alias("lat"), p["lng"].alias("lng"))).alias("geometry")
             ).createOrReplaceTempView("routes_for_sql")
    out = spark.sql("SELECT route_id, r.* FROM routes_for_sql, LATERAL resample_route(geometry, 60.0D) r")
    return rounded(rounded(out, 3, "target_m"), 7, "lat", "lng")
