"""Queries over GPS fixes: cleaning, following, alerts, roads, sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo, osm, solar
from ..operators import analysis, lookups, paths, roads
from ..operators.spatial import nearest_segment
from ..streaming import navigation as nav
from . import sqltext as S
from .registry import query, rounded
from .views import cte, ntz_ms, routes, table, view

FIX = cte("fx_gps_fixes")
PREV = """pv AS (SELECT *, lag(lat) OVER w la, lag(lng) OVER w ln, (fix_ms-lag(fix_ms) OVER w)/1000.0::DOUBLE ds FROM fx_gps_fixes WINDOW w AS (PARTITION BY session_id ORDER BY fix_ms, fix_id)),
sp AS (SELECT *, CASE WHEN reported_speed_kmh>=0 THEN reported_speed_kmh WHEN ds>0.5 AND {h}/ds<50 THEN {h}/ds*3.6 ELSE 0 END kmh FROM pv)""".format(h=S.hav("la", "ln", "lat", "lng"))


def _fixes(spark, sf):
    return view(spark, sf, "fx_gps_fixes")


@query("R4_speeds", f"""{FIX}, {PREV}
SELECT fix_id, round(kmh,5) AS speed_kmh, CAST(floor(round(kmh,5)*0.621371+0.5) AS BIGINT) AS shown_mph FROM sp""")
def r4(spark, sf):
    out = rounded(nav.reported_or_implied_speed(_fixes(spark, sf)), 5, "speed_kmh")
    return out.select("fix_id", "speed_kmh", nav.speed_for_display("speed_kmh", F.lit("mph")).alias("shown_mph"))


ACCEPT = f"""{FIX.replace('WITH', 'WITH RECURSIVE', 1)},
o AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY fix_ms, fix_id) n FROM fx_gps_fixes),
r AS (SELECT session_id, n, fix_id, NULL::BIGINT lms, NULL::DOUBLE lla, NULL::DOUBLE lln, NULL::DOUBLE lac, '' lsrc, 'START' reason, fix_ms ms, lat, lng, accuracy, source, reported_speed_kmh rs FROM o WHERE n=1
 UNION ALL SELECT 0,0,0,0,0,0,0,'','',0,0,0,0,'',0 WHERE false),
st AS (SELECT session_id, CAST(0 AS BIGINT) n, CAST(NULL AS BIGINT) fix_id, CAST(NULL AS BIGINT) lms, CAST(NULL AS DOUBLE) lla, CAST(NULL AS DOUBLE) lln, CAST(NULL AS DOUBLE) lac, CAST('' AS VARCHAR) lsrc, CAST('' AS VARCHAR) reason
 FROM (SELECT DISTINCT session_id FROM o)
 UNION ALL SELECT session_id, n, fix_id, CASE WHEN ok THEN fix_ms ELSE lms END, CASE WHEN ok THEN lat ELSE lla END, CASE WHEN ok THEN lng ELSE lln END, CASE WHEN ok THEN accuracy ELSE lac END,
  CASE WHEN reason='DUPLICATE_FIX' THEN lsrc ELSE source END, reason FROM
 (SELECT *, reason IN ('FIRST_RELIABLE_FIX','RELIABLE_FIX') ok FROM
 (SELECT *, CASE WHEN m<=3 AND fix_ms-lms<=1500 AND accuracy+0.5>=lac AND (source LIKE 'native%')<=(lsrc LIKE 'native%') THEN 'DUPLICATE_FIX' WHEN accuracy>50 THEN 'LOW_ACCURACY' WHEN lms IS NULL THEN 'FIRST_RELIABLE_FIX'
  WHEN m/(fix_ms-lms)*3600>220 THEN 'IMPLAUSIBLE_JUMP' WHEN kmh<=3.5 AND fix_ms-lms<=8000 AND m>greatest(60,(lac+accuracy)*2) THEN 'STATIONARY_JUMP' ELSE 'RELIABLE_FIX' END reason FROM
 (SELECT *, CASE WHEN rs>=0 THEN rs WHEN fix_ms-lms>500 AND m/(fix_ms-lms)*1000<50 THEN m/(fix_ms-lms)*3600 ELSE 0 END kmh FROM
 (SELECT st.session_id, o.n, o.fix_id, lms, lla, lln, lac, lsrc, fix_ms, lat, lng, accuracy, source, reported_speed_kmh rs, {S.hav('lla', 'lln', 'lat', 'lng')} m FROM st JOIN o ON o.session_id=st.session_id AND o.n=st.n+1)))))
SELECT fix_id, reason FROM st WHERE n>0"""


@query("R1_R2_R3_clean_fixes", ACCEPT.replace(ACCEPT[ACCEPT.index("r AS (SELECT session_id, n"):ACCEPT.index("st AS (")], ""))
def r3(spark, sf):
    return nav.clean_fixes(_fixes(spark, sf)).select("fix_id", "reason")


@query("R5_headings")
def r5(spark, sf):
    out = nav.clean_fixes(_fixes(spark, sf)).filter("accepted")
    return rounded(out, 5, "heading", "speed_kmh").select("fix_id", "heading", "speed_kmh")


def _session_routes(spark, sf):
    """The road a session drives: its fixes, moved a little and numbered densely."""
    from pyspark.sql import Window

    w = Window.partitionBy("session_id").orderBy("fix_ms", "fix_id")
    return _fixes(spark, sf).select(F.col("session_id").alias("route_id"), (F.row_number().over(w) - 1).cast("long").alias("v_idx"),
                                    (F.col("lat") + 0.0001).alias("lat"), "lng")


def _running(spark, sf):
    return paths.with_running_m(paths.with_heading(paths.route_segments(_session_routes(spark, sf))))


def _followed(spark, sf):
    run = paths.with_last_segment(_running(spark, sf))
    ends = run.filter("seg_idx = last_seg").select("route_id", F.col("lat2").alias("end_lat"), F.col("lng2").alias("end_lng"), "last_seg")
    cleaned = nav.clean_fixes(_fixes(spark, sf)).withColumn("route_id", F.col("session_id"))
    return nav.follow_routes(nav.with_near(cleaned, nav.nearby_segments(run), ends, segments=run))


@query("R6_R9_R10_followed")
def r6(spark, sf):
    return rounded(_followed(spark, sf), 5, "seg_t", "off_route_m").select(
        "fix_id", "seg_idx", "seg_t", "snapped", "off_route_m", "event")


@query("R7_remaining")
def r7(spark, sf):
    f = _followed(spark, sf).filter("seg_idx IS NOT NULL").withColumnRenamed("seg_t", "t")
    meta = _fixes(spark, sf).groupBy(F.col("session_id").alias("route_id")).agg(
        F.min("fix_ms").alias("start_ms"), ((F.max("fix_ms") - F.min("fix_ms")) / 1000.0).alias("duration_sec"))
    run = paths.with_running_m(paths.route_segments(_session_routes(spark, sf)), meta)
    timed = paths.with_uniform_times(run)
    pos = f.select("fix_id", "route_id", "seg_idx", "t", F.col("snap_lat").alias("lat"), F.col("snap_lng").alias("lng"))
    out = paths.remaining_s(paths.remaining_m(pos, run), timed)
    out = out.withColumn("remaining_s", F.greatest(F.lit(30.0), F.floor(F.col("remaining_s") + 0.5)))
    return rounded(out, 3, "remaining_m").select("fix_id", "remaining_m", "remaining_s")


def _prepared(spark, sf):
    """Fixes with everything the alert rules look at."""
    k = F.col("fix_id")
    f = nav.clean_fixes(_fixes(spark, sf)).filter("accepted")
    m = _session_routes(spark, sf).select("route_id", "v_idx", "lat", "lng", F.lit("turn").alias("type"), F.lit("left").alias("modifier"))
    at = f.select("fix_id", F.col("session_id").alias("route_id"), "lat", "lng", "heading", F.lit(None).cast("long").alias("seg_idx"))
    nxt = nav.next_maneuver(at, m)
    rows = f.join(nxt, "fix_id", "left").withColumn("glare", (k * 37 % 100) / 100.0)
    return rows.withColumns({
        "turn_key": nav.turn_key("maneuver_m", "m_lat", "m_lng", "type", "modifier"),
        "hazard_key": F.when(F.col("maneuver_m").isNull(), nav.hazard_key(F.lit(200.0), "glare")),
        "speed_limit_kmh": F.when(k % 6 != 0, F.lit(60.0)), "toll_booth_ahead": k % 40 == 0,
        "road_class": nav.road_class((k / 30).cast("long") % 2 == 0, (k / 60).cast("long") % 2 == 0)})


@query("R13_R17_alerts")
def r13(spark, sf):
    return nav.alerts(_prepared(spark, sf))


@query("R18_rule_refresh")
def r18(spark, sf):
    f = nav.clean_fixes(_fixes(spark, sf)).filter("accepted").withColumns(
        {"route_id": F.col("session_id"), "seg_idx": F.floor(F.col("fix_id") / 50)})
    return nav.rule_refreshes(f).select("fix_id", "refresh")


MAN = """m AS (SELECT route_id, v_idx, lat, lng FROM fx_route_vertices),
f AS (SELECT route_id*1000+v_idx fix_id, route_id, v_idx, lat-0.0001 lat, lng+0.0001 lng, CAST((route_id*13+v_idx*71)%360 AS DOUBLE) heading FROM fx_route_vertices)"""


@query("R12_J20_next_maneuver", f"""{cte('fx_route_vertices')}, {MAN},
p AS (SELECT fix_id, m.v_idx, {S.hav('f.lat', 'f.lng', 'm.lat', 'm.lng')} d, {S.angle(S.bearing('f.lat', 'f.lng', 'm.lat', 'm.lng'), 'heading')} a FROM f JOIN m ON m.route_id=f.route_id AND m.v_idx>=f.v_idx-2)
SELECT fix_id, v_idx AS m_idx, round(d,3) AS maneuver_m FROM p WHERE d<2000 AND (a<120 OR d<60) QUALIFY row_number() OVER (PARTITION BY fix_id ORDER BY v_idx, d)=1""")
def r12(spark, sf):
    v = view(spark, sf, "fx_route_vertices")
    m = v.select("route_id", "v_idx", "lat", "lng", F.lit("turn").alias("type"), F.lit("left").alias("modifier"))
    f = v.select((F.col("route_id") * 1000 + F.col("v_idx")).alias("fix_id"), "route_id", (F.col("lat") - 0.0001).alias("lat"), (F.col("lng") + 0.0001).alias("lng"),
                 ((F.col("route_id") * 13 + F.col("v_idx") * 71) % 360).cast("double").alias("heading"), F.col("v_idx").alias("seg_idx"))
    return rounded(nav.next_maneuver(f, m), 3, "maneuver_m").select("fix_id", "m_idx", "maneuver_m")


@query("R8_F35_F36_eta_uncertainty", f"""{FIX}
SELECT fix_id, CASE WHEN source LIKE 'native-%' THEN 0.68 ELSE 0.95 END::DOUBLE AS confidence, CASE WHEN source LIKE 'native-%' THEN 'android-location-horizontal-68' ELSE 'w3c-geolocation-horizontal-95' END AS accuracy_source,
 CASE WHEN fix_id%7>0 THEN round(accuracy/((fix_id%7)*100.0::DOUBLE/(60+fix_id%50)),6) END AS seconds FROM fx_gps_fixes""")
def r8(spark, sf):
    k = F.col("fix_id")
    level, name = nav.accuracy_metadata("source")
    out = _fixes(spark, sf).select("fix_id", level.alias("confidence"), name.alias("accuracy_source"), nav.eta_uncertainty_s(
        "accuracy", (k % 7) * 100.0, (k % 50 + 60).cast("double")).alias("seconds"))
    return rounded(out, 6, "seconds")


@query("R16_speeding_episodes", f"""{FIX}, {PREV},
ov AS (SELECT *, coalesce(kmh>CASE WHEN fix_id%9<>0 THEN 70 END,false) ov FROM sp),
rn AS (SELECT *, sum(CASE WHEN ov THEN 0 ELSE 1 END) OVER (PARTITION BY session_id ORDER BY fix_ms, fix_id) g FROM ov)
SELECT session_id, min(fix_ms) AS start_ms, max(fix_ms) AS end_ms, count(*) AS fixes, round(max(kmh),5) AS top_kmh FROM rn WHERE ov GROUP BY session_id, g""")
def r16(spark, sf):
    f = nav.reported_or_implied_speed(_fixes(spark, sf)).withColumn("speed_limit_kmh", F.when(F.col("fix_id") % 9 != 0, F.lit(70.0)))
    return rounded(nav.speeding_episodes(f), 5, "top_kmh")


@query("W13_off_route_counts", f"""{FIX}, o AS (SELECT fix_id, session_id, fix_ms, CASE WHEN (fix_id*37)%120>45 THEN 1 ELSE 0 END off FROM fx_gps_fixes),
g AS (SELECT *, sum(1-off) OVER (PARTITION BY session_id ORDER BY fix_ms, fix_id) g FROM o)
SELECT fix_id, CAST(sum(off) OVER (PARTITION BY session_id, g ORDER BY fix_ms, fix_id) AS BIGINT) AS off_count FROM g""")
def w13(spark, sf):
    f = _fixes(spark, sf).withColumn("off_route_m", (F.col("fix_id") * 37 % 120).cast("double"))
    return nav.off_route_counts(f).select("fix_id", "off_count")


@query("R19_debounced", """WITH e AS (SELECT user_id, ts, event_id, epoch_us(ts) us FROM events),
g AS (SELECT *, CASE WHEN us-lag(us) OVER w<3600000000 THEN 0 ELSE 1 END s FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)),
h AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY us, event_id) k FROM g)
SELECT user_id, arg_max(event_id, us) AS event_id, count(*) AS burst FROM h GROUP BY user_id, k""")
def r19(spark, sf):
    e = table(spark, sf, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id")
    # The table's events are minutes apart, so the burst gap here is an hour.
    return nav.last_of_burst(e, "1 hour", key="user_id").select("user_id", "event_id", "burst")


@query("R20_trips", """WITH e AS (SELECT user_id, epoch_us(ts) us FROM events),
g AS (SELECT *, CASE WHEN us-lag(us) OVER w<43200000000 THEN 0 ELSE 1 END s FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us)),
h AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING) k FROM g)
SELECT user_id, min(us)//1000 AS started_ms, max(us)//1000 AS last_ms, count(*) AS events FROM h GROUP BY user_id, k""")
def r20(spark, sf):
    e = table(spark, sf, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return nav.trips(e, key="user_id").select("user_id", F.unix_millis("started").alias("started_ms"), F.unix_millis("last_seen").alias("last_ms"), "events")


@query("R21_latest_results", """SELECT user_id AS request_key, event_id AS generation, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC)=1""")
def r21(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("request_key"), F.col("event_id").alias("generation"), "value")
    return nav.latest_results(e).select("request_key", "generation", "value")


@query("R22_cells_once", f"{FIX} SELECT DISTINCT concat(printf('%.3f',lat),',',printf('%.3f',lng)) AS cell FROM fx_gps_fixes")
def r22(spark, sf):
    return roads.cells_to_look_up(_fixes(spark, sf))


LOOKUPS = f"""{FIX.replace('WITH', 'WITH RECURSIVE', 1)},
r AS (SELECT concat(floor(lat*100)::BIGINT,',',floor(lng*100)::BIGINT) AS cell, fix_ms AS t, fix_id AS id, CASE WHEN hw_heading IS NOT NULL THEN 900000 ELSE 30000 END AS life FROM fx_gps_fixes),
asked AS (SELECT cell, min({{'t':t,'id':id,'life':life}}) AS n FROM r GROUP BY cell
 UNION ALL SELECT a.cell, min({{'t':r.t,'id':r.id,'life':r.life}}) FROM asked a JOIN r ON r.cell=a.cell AND r.t>=a.n.t+a.n.life GROUP BY a.cell),
m AS (SELECT r.cell, r.t, r.id, a.n IS NOT NULL AS asks FROM r LEFT JOIN asked a ON a.cell=r.cell AND a.n.t=r.t AND a.n.id=r.id)
SELECT id AS fix_id, cell, asks, last_value(CASE WHEN asks THEN id END IGNORE NULLS) OVER (PARTITION BY cell ORDER BY t, id ROWS UNBOUNDED PRECEDING) AS answered_by FROM m"""


@query("R22_timed_lookups", LOOKUPS)
def r22_timed(spark, sf):
    """Every fix asks for its cell of about a kilometre; a fix without a heading stands for a failed look-up."""
    cell = F.concat_ws(",", F.floor(F.col("lat") * 100), F.floor(F.col("lng") * 100))
    fixes = _fixes(spark, sf).withColumn("cell", cell)
    out = lookups.timed_lookups(fixes, lookups.life_ms(F.col("hw_heading").isNotNull()))
    return out.select("fix_id", "cell", "asks", "answered_by")


@query("R23_dark_state", """WITH m AS (SELECT event_id, user_id, ts, value*2 v, CASE WHEN value*2<30 THEN true WHEN value*2>80 THEN false END k FROM events)
SELECT event_id, coalesce(last_value(k IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING),false) AS is_dark,
 coalesce(last_value(k IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING),false) OR event_id%10=0 OR event_id%90-20<-0.02 AS dark_theme FROM m""")
def r23(spark, sf):
    e = table(spark, sf, "events").withColumn("v", F.col("value") * 2)
    out = nav.dark_state(e, "v", ["ts", "event_id"], "user_id")
    return out.select("event_id", "is_dark", nav.dark_theme("is_dark", F.col("event_id") % 10 == 0, (F.col("event_id") % 90 - 20).cast("double")).alias("dark_theme"))


@query("T11_first_usable_fix", f"""{FIX}
SELECT session_id, fix_id, accuracy FROM fx_gps_fixes WHERE accuracy>0 AND accuracy<=50 QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY accuracy>30, CASE WHEN accuracy>30 THEN accuracy ELSE 0 END, fix_ms, fix_id)=1""")
def t11(spark, sf):
    return nav.first_usable_fix(_fixes(spark, sf)).select("session_id", "fix_id", "accuracy")


LIVE = f"""{FIX}, a AS ({S.bird(S.sun('SELECT fix_id, lat, lng, fix_ms, coalesce(hw_heading,0) hd FROM fx_gps_fixes', 'lat', 'lng', 'fix_ms'), '90-sun_altitude', 'fix_ms')}),
b AS (SELECT *, degrees(acos(greatest(-1,least(1,cos(radians(sun_altitude))*cos(radians({S.angle('hd', 'sun_azimuth')})))))) th, CASE WHEN fix_id%3<>0 AND abs(fix_id%40-20)<=15 THEN fix_id%2 ELSE 0 END oc FROM a)
SELECT fix_id, round(CASE WHEN dni<=0 OR oc>=1 OR th>=100 OR sun_altitude<=0 THEN 0 ELSE 1-exp(-(10*(dni*93*greatest(0,cos(radians(th)))*(1-oc))/pow(greatest(1,th),2))/1000) END,6) AS glare FROM b"""


@query("R11_J21_live_glare", LIVE)
def r11(spark, sf):
    k = F.col("fix_id")
    f = _fixes(spark, sf).select("fix_id", "lat", "lng", (F.col("fix_ms") + 0).alias("fix_ms"), F.coalesce("hw_heading", F.lit(0.0)).alias("heading"))
    f = f.withColumns({"pass_ms": F.col("fix_ms") + (k % 40 - 20) * 60000, "occlusion": F.when(k % 3 != 0, (k % 2).cast("double"))})
    out = analysis.live_glare(f, "compact")
    return rounded(out, 6, "glare").select("fix_id", "glare")


@query("P20_starts_at_vehicle", f"""{cte('fx_route_vertices')}, s AS ({S.segments()}),
p AS (SELECT route_id, lat+0.0004*(route_id%5) plat, lng plng, CAST((route_id*29)%360 AS DOUBLE) hd FROM fx_route_vertices WHERE v_idx=0),
a AS (SELECT route_id, seg_idx, heading, hd, plat, plng, lat1, lng1, lat2, lng2, {S.frac('plat', 'plng', 'lat1', 'lng1', 'lat2', 'lng2')} t FROM p JOIN s USING (route_id)),
d AS (SELECT *, {S.hav('plat', 'plng', 'lat1+(lat2-lat1)*t', 'lng1+(lng2-lng1)*t')} m FROM a),
n AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY route_id ORDER BY round(m,6), seg_idx)=1)
SELECT route_id, m<=120 AND {S.angle('hd', 'heading')}<=120 AS starts_here FROM n""")
def p20(spark, sf):
    v = view(spark, sf, "fx_route_vertices")
    run = paths.with_heading(paths.route_segments(v)).withColumnRenamed("heading", "road_bearing")
    p = v.filter("v_idx = 0").select("route_id", F.col("route_id").alias("point_id"), (F.col("lat") + 0.0004 * (F.col("route_id") % 5)).alias("lat"), "lng",
                                     ((F.col("route_id") * 29) % 360).cast("double").alias("heading"))
    near = nearest_segment(p, run, carry=["road_bearing"])
    out = p.join(near.select("point_id", "distance", "road_bearing"), "point_id")
    ok = (F.col("distance") <= 120) & F.coalesce(geo.angle_between("heading", "road_bearing") <= 120, F.lit(True))
    return out.select("route_id", ok.alias("starts_here"))


ROADS = """w AS (SELECT way_id, name, highway, toll, maxspeed, 42+(way_id*97)%500000/1000000.0::DOUBLE a, -71-(way_id*61)%500000/1000000.0::DOUBLE b, way_id%7*0.0008-0.002 da, way_id%5*0.0009-0.002 db FROM fx_road_tags),
sg AS (SELECT *, a lat1, b lng1, a+da lat2, b+db lng2, 0 i FROM w UNION ALL SELECT *, a+da, b+db, a+da*2, b+db*1.5, 1 FROM w),
f AS (SELECT way_id*2+h fix_id, a+da*0.5+h*0.0002 lat, b+db*0.5+0.0001 lng, CASE WHEN way_id%4=0 THEN NULL ELSE CAST((way_id*31)%360 AS DOUBLE) END hd, CASE WHEN way_id%3=0 THEN name ELSE '' END rn FROM w, (VALUES (0),(1)) v(h))"""


def _roads(spark, sf):
    k = F.col("way_id")
    r = view(spark, sf, "fx_road_tags").withColumns({
        "a": F.lit(42.0) + (k * 97) % 500000 / 1000000.0, "b": F.lit(-71.0) - (k * 61) % 500000 / 1000000.0,
        "da": k % 7 * 0.0008 - 0.002, "db": k % 5 * 0.0009 - 0.002})
    at = lambda i, j: F.struct((F.col("a") + F.col("da") * i).alias("lat"), (F.col("b") + F.col("db") * j).alias("lng"))
    line = r.withColumn("line", F.array(at(0, 0), at(1, 1), at(2, 1.5)))
    fixes = r.withColumn("h", F.explode(F.array(F.lit(0), F.lit(1)))).select(
        (k * 2 + F.col("h")).alias("fix_id"), (F.col("a") + F.col("da") * 0.5 + F.col("h") * 0.0002).alias("lat"),
        (F.col("b") + F.col("db") * 0.5 + 0.0001).alias("lng"), F.when(k % 4 != 0, ((k * 31) % 360).cast("double")).alias("heading"),
        F.when(k % 3 == 0, F.col("name")).otherwise("").alias("road_name"))
    return line.select("way_id", "line", "name", "highway", "toll", "maxspeed"), fixes


@query("J17_S16_best_road", f"""{cte('fx_road_tags')}, {ROADS},
p AS (SELECT fix_id, way_id, hd, rn, name, lat, lng, lat1, lng1, lat2, lng2, {S.bearing('a', 'b', 'a+da*2', 'b+db*1.5')} br, {S.frac('lat', 'lng', 'lat1', 'lng1', 'lat2', 'lng2')} t FROM f JOIN sg ON abs(lat-a)<0.02 AND abs(lng-b)<0.02),
d AS (SELECT *, {S.hav('lat', 'lng', 'lat1+(lat2-lat1)*t', 'lng1+(lng2-lng1)*t')} m FROM p),
s AS (SELECT fix_id, way_id, m+coalesce({S.angle('br', 'hd')}*2,0)-CASE WHEN rn<>'' AND name<>'' AND (contains(rn,name) OR contains(name,rn)) THEN 80 ELSE 0 END sc FROM d WHERE m<=45)
SELECT fix_id, way_id, round(sc,4) AS match_score FROM s QUALIFY row_number() OVER (PARTITION BY fix_id ORDER BY round(sc,7), way_id)=1""")
def j17(spark, sf):
    r, f = _roads(spark, sf)
    return rounded(roads.best_road(f, r), 4, "match_score").select("fix_id", "way_id", "match_score")


@query("J18_signs", f"""{cte('fx_road_tags')}, {ROADS}, g AS (SELECT a+da*0.4 la, b+db*0.6 ln, way_id FROM w)
SELECT fix_id, EXISTS (SELECT 1 FROM g WHERE abs(la-lat)<0.01 AND abs(ln-lng)<0.01 AND {S.hav('lat', 'lng', 'la', 'ln')}<=45) AS stop_ahead,
 EXISTS (SELECT 1 FROM g WHERE abs(la-lat)<0.01 AND abs(ln-lng)<0.01 AND {S.hav('lat', 'lng', 'la', 'ln')}<=90) AS toll_booth_ahead FROM f""")
def j18(spark, sf):
    r, f = _roads(spark, sf)
    p = lambda i: F.element_at("line", i)
    mid = lambda c, x: p(1)[c] + (p(2)[c] - p(1)[c]) * x
    g = r.select(mid("lat", 0.4).alias("lat"), mid("lng", 0.6).alias("lng"))
    return roads.near_points(f, g, roads.STOP_M, "stop_ahead").join(roads.near_points(f, g, roads.BOOTH_M, "toll_booth_ahead"), "fix_id")
