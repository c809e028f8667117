"""Route geometry, time, sun and summary queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo, keys, solar
from ..functions.ephemeris import with_spa_day_times, with_spa_sun
from ..operators import analysis, paths, resample, similarity
from ..operators.spatial import nearest_segment
from . import sqltext as S
from .registry import query, rounded
from .views import cte, routes, table, view

VERTS = cte("fx_route_vertices")
BOTH = cte("fx_route_vertices", "fx_routes")


def _verts(spark, sf):
    return view(spark, sf, "fx_route_vertices")


def _running(spark, sf):
    return paths.with_running_m(paths.with_heading(paths.route_segments(_verts(spark, sf))))


def _exposed(spark, sf):
    return analysis.exposed_segments(analysis.timed_segments(_verts(spark, sf), routes(spark, sf)), "compact")


@query("W1_segments", f"""{VERTS}
SELECT route_id, seg_idx, round(seg_m,3) AS seg_m, round(heading,5) AS heading FROM ({S.segments()})""")
def w1(spark, sf):
    out = paths.with_heading(paths.route_segments(_verts(spark, sf)))
    return rounded(rounded(out, 3, "seg_m"), 5, "heading").select("route_id", "seg_idx", "seg_m", "heading")


@query("W2_running_distance", f"""{VERTS}
SELECT route_id, seg_idx, round(start_m,3) AS start_m, round(end_m,3) AS end_m, round(total_m,3) AS total_m FROM ({S.running()})""")
def w2(spark, sf):
    return rounded(_running(spark, sf), 3, "start_m", "end_m", "total_m").select(
        "route_id", "seg_idx", "start_m", "end_m", "total_m")


@query("A2_route_extent", f"""{VERTS},
l AS (SELECT route_id, sum(seg_m) AS length_m FROM ({S.segments()}) GROUP BY 1),
b AS (SELECT route_id, min(lat) s0, max(lat) n0, min(lng) w0, max(lng) e0 FROM fx_route_vertices GROUP BY 1),
p AS (SELECT route_id, s0-degrees(250/6371000.0) south, n0+degrees(250/6371000.0) north,
 w0-degrees(250/(6371000*cos(radians((s0+n0)/2)))) west, e0+degrees(250/(6371000*cos(radians((s0+n0)/2)))) east FROM b),
m AS (SELECT *, {S.hav('(south+north)/2', 'west', '(south+north)/2', 'east')} w, {S.hav('south', 'west', 'north', 'west')} h FROM p)
SELECT route_id, round(length_m,3) AS length_m, round(south,6) AS south, round(west,6) AS west, round(north,6) AS north,
 round(east,6) AS east, round(w,3) AS width_m, round(h,3) AS height_m, round(w*h/1e6,6) AS area_km2 FROM m JOIN l USING (route_id)""")
def a2(spark, sf):
    v = _verts(spark, sf)
    out = paths.route_extent(v).join(paths.route_lengths(paths.route_segments(v)), "route_id")
    out = rounded(rounded(out, 3, "length_m", "width_m", "height_m"), 6, "south", "west", "north", "east", "area_km2")
    return out.select("route_id", "length_m", "south", "west", "north", "east", "width_m", "height_m", "area_km2")


@query("J11_step_times", f"""{cte('fx_route_vertices', 'fx_routes', 'fx_steps')},
r AS ({S.running()}),
v AS (SELECT route_id, seg_idx v_idx, start_m along_m, total_m, false is_last FROM r
 UNION ALL SELECT route_id, seg_idx+1, end_m, total_m, true FROM (SELECT *, max(seg_idx) OVER (PARTITION BY route_id) mx FROM r) WHERE seg_idx=mx),
s0 AS (SELECT * FROM fx_steps WHERE distance>0),
s AS (SELECT *, sum(distance) OVER (PARTITION BY route_id ORDER BY step_idx) hi, sum(duration) OVER (PARTITION BY route_id ORDER BY step_idx) his,
 sum(distance) OVER (PARTITION BY route_id) sm, sum(duration) OVER (PARTITION BY route_id) ss,
 row_number() OVER (PARTITION BY route_id ORDER BY step_idx) k, count(*) OVER (PARTITION BY route_id) kn FROM s0),
j AS (SELECT v.*, duration_sec, hi, his, distance, duration, ss, sm, k, along_m*(sm/total_m) tgt FROM v JOIN fx_routes USING (route_id)
 LEFT JOIN s ON s.route_id=v.route_id AND ss>0 AND total_m>0 AND duration_sec>0
 AND (along_m*(sm/total_m)>hi-distance OR k=1) AND (along_m*(sm/total_m)<=hi OR k=kn))
SELECT route_id, v_idx, round(CASE WHEN k IS NULL THEN CASE WHEN total_m>0 THEN along_m/total_m*duration_sec ELSE 0 END
 WHEN is_last THEN duration_sec ELSE greatest(0,least(duration_sec,(his-duration)*duration_sec/ss+(tgt-(hi-distance))/distance*duration*duration_sec/ss)) END,4) AS elapsed_s FROM j""")
def j11(spark, sf):
    v = paths.vertices_along(paths.with_running_m(paths.route_segments(_verts(spark, sf)), last=True))
    out = paths.step_times(v, view(spark, sf, "fx_steps"), routes(spark, sf).select("route_id", "duration_sec"))
    return rounded(out, 4, "elapsed_s").select("route_id", "v_idx", "elapsed_s")


@query("W3_step_totals", f"""{cte('fx_steps')}
SELECT route_id, step_idx, sum(distance) OVER w AS hi_m, sum(duration) OVER w AS hi_s,
 sum(distance) OVER (PARTITION BY route_id) AS steps_m FROM fx_steps WHERE distance>0 WINDOW w AS (PARTITION BY route_id ORDER BY step_idx)""")
def w3(spark, sf):
    return paths.usable_steps(view(spark, sf, "fx_steps")).select("route_id", "step_idx", "hi_m", "hi_s", "steps_m")


@query("W4_sharp_turns", f"""{VERTS},
t AS (SELECT route_id, seg_idx+1 v_idx, heading, lead(heading) OVER (PARTITION BY route_id ORDER BY seg_idx) nx FROM ({S.segments()}))
SELECT route_id, v_idx, round({S.angle('heading', 'nx')},4) AS turn_deg FROM t WHERE {S.angle('heading', 'nx')}>=18""")
def w4(spark, sf):
    return rounded(paths.sharp_turns(paths.route_segments(_verts(spark, sf))), 4, "turn_deg")


@query("W5_W6_remaining", f"""{BOTH},
p AS (SELECT *, lat1+(lat2-lat1)*0.25 plat, lng1+(lng2-lng1)*0.25 plng FROM ({S.timed()}))
SELECT route_id, seg_idx, round({S.hav('plat', 'plng', 'lat2', 'lng2')}+total_m-end_m,3) AS remaining_m,
 round(greatest(0,least(duration_sec,duration_sec-(t0+(t1-t0)*0.25))),4) AS remaining_s FROM p""")
def w5(spark, sf):
    timed = analysis.timed_segments(_verts(spark, sf), routes(spark, sf))
    pos = timed.select("route_id", "seg_idx", geo.along("lat1", "lat2", 0.25).alias("lat"),
                       geo.along("lng1", "lng2", 0.25).alias("lng"), F.lit(0.25).alias("t"))
    out = paths.remaining_s(paths.remaining_m(pos, timed), timed)
    return rounded(rounded(out, 3, "remaining_m"), 4, "remaining_s").select("route_id", "seg_idx", "remaining_m", "remaining_s")


SUMMARY = ["avg_glare", "avg_shade", "exposure_units", "sunlit_distance_ratio", "sunlit_time_ratio",
           "confirmed_shade_ratio", "confirmed_shade_time_ratio", "uncertain_time_ratio", "estimated_shade_ratio"]


@query("A1_route_analysis", f"""{BOTH},
x AS MATERIALIZED ({S.exposed()}),
g AS (SELECT route_id, count(*) n, max(total_m) total_m, max(duration_sec) dur, sum(segment_s) ts, sum(seg_m) sm, sum(glare*segment_s) gs,
 sum(glare*seg_m) gm, sum(shade_potential*seg_m) shm, sum(direct_exposure*seg_m) em, sum(direct_wh) dw, sum(diffuse_wh) fw,
 coalesce(sum(segment_s) FILTER (WHERE sunlit),0) ss, coalesce(sum(seg_m) FILTER (WHERE sunlit),0) sl,
 coalesce(sum(seg_m) FILTER (WHERE shade_state='estimated-shade'),0) egm,
 coalesce(sum(shade_potential*seg_m) FILTER (WHERE shade_state='estimated-shade'),0) eg FROM x GROUP BY 1)
SELECT route_id, n AS n_segments, round(total_m,3) AS total_m, round(ts,3) AS total_time_s, round(CASE WHEN dur>0 THEN gs/ts ELSE gm/sm END,6) AS avg_glare,
 round(shm/total_m,6) AS avg_shade, round(CASE WHEN ts>0 THEN greatest(0,least(1.5,dw*3600/ts/1000)) ELSE em/total_m END,6) AS exposure_units,
 round(dw,5) AS direct_wh, round(dw,5) AS clear_direct_wh, round(fw,5) AS diffuse_wh, round(ss,3) AS sunlit_s, round(sl/total_m,6) AS sunlit_distance_ratio,
 round(ss/ts,6) AS sunlit_time_ratio, 0.0::DOUBLE AS confirmed_shade_ratio, 0.0::DOUBLE AS confirmed_shade_time_ratio, 0.0::DOUBLE AS uncertain_time_ratio,
 round(CASE WHEN egm>0 THEN eg/egm ELSE 0 END,6) AS estimated_shade_ratio FROM g""")
def a1(spark, sf):
    out = analysis.route_summary(_exposed(spark, sf))
    out = rounded(out, 3, "total_m", "total_time_s", "sunlit_s")
    out = rounded(rounded(out, 5, "direct_wh", "clear_direct_wh", "diffuse_wh"), 6, *SUMMARY)
    return out.select("route_id", "n_segments", "total_m", "total_time_s", "direct_wh", "clear_direct_wh", "diffuse_wh",
                      "sunlit_s", *SUMMARY)


@query("P5_night_routes", f"""{BOTH}, x AS MATERIALIZED ({S.exposed()})
SELECT route_id, bool_and(sun_altitude<=0) AS night_only FROM x GROUP BY 1""")
def p5(spark, sf):
    return analysis.night_only_routes(_exposed(spark, sf))


@query("F25_F28_segment_exposure", f"""{BOTH}
SELECT route_id, seg_idx, round(dni,3) AS dni, round(dhi,3) AS dhi, round(ghi,3) AS ghi, round(direct_horizontal,3) AS direct_horizontal,
 round(theta,4) AS theta_deg, round(glare,6) AS glare, round(shade_potential,6) AS shade_potential, round(direct_exposure,6) AS direct_exposure,
 shade_state FROM ({S.exposed()})""")
def f25(spark, sf):
    out = rounded(_exposed(spark, sf), 3, "dni", "dhi", "ghi", "direct_horizontal")
    out = rounded(rounded(out, 4, "theta_deg"), 6, "glare", "shade_potential", "direct_exposure")
    return out.select("route_id", "seg_idx", "dni", "dhi", "ghi", "direct_horizontal", "theta_deg", "glare",
                      "shade_potential", "direct_exposure", "shade_state")


@query("F20_F24_F30_solar_scalars", f"""{BOTH},
b AS (SELECT v.route_id, v_idx, lat, lng, start_ms, CAST((v.route_id*37)%3000 AS DOUBLE) AS elevation_m FROM fx_route_vertices v JOIN fx_routes USING (route_id)),
s AS ({S.sun('SELECT * FROM b', 'lat', 'lng', 'start_ms')}),
y AS (SELECT *, year(d)+(month(d)-0.5)/12 AS yy FROM (SELECT *, DATE '1970-01-01'+CAST(floor(start_ms/86400000.0::DOUBLE) AS INTEGER) AS d FROM s)),
z AS ({S.bird('SELECT * FROM y', '90-sun_altitude', 'start_ms', "(100*pow((44331.514::DOUBLE-elevation_m)/11880.516,1/0.1902632::DOUBLE))")})
SELECT route_id, v_idx, round(sun_azimuth,5) AS sun_azimuth, round(sun_altitude,5) AS sun_altitude,
 round(100*pow((44331.514::DOUBLE-elevation_m)/11880.516,1/0.1902632::DOUBLE),3) AS pressure_pa,
 round(1364*(1+0.033*cos(2*pi()*dayofyear(d)/365.0::DOUBLE)),5) AS etr,
 round(CASE WHEN yy BETWEEN 2005 AND 2050 THEN 62.92+0.32217*(yy-2000)+0.005589*(yy-2000)*(yy-2000) ELSE 69 END,5) AS delta_t,
 round(CASE WHEN sun_altitude>0 THEN 1/(cos(radians(90-sun_altitude))+0.15*pow(93.885::DOUBLE-(90-sun_altitude),-1.253)) END,6) AS airmass, round(ghi,3) AS ghi,
 CASE WHEN floor(sun_azimuth+0.5)>=22.5 AND floor(sun_azimuth+0.5)<67.5 THEN 'NE' WHEN floor(sun_azimuth+0.5)>=67.5 AND floor(sun_azimuth+0.5)<112.5 THEN 'E'
  WHEN floor(sun_azimuth+0.5)>=112.5 AND floor(sun_azimuth+0.5)<157.5 THEN 'SE' WHEN floor(sun_azimuth+0.5)>=157.5 AND floor(sun_azimuth+0.5)<202.5 THEN 'S'
  WHEN floor(sun_azimuth+0.5)>=202.5 AND floor(sun_azimuth+0.5)<247.5 THEN 'SW' WHEN floor(sun_azimuth+0.5)>=247.5 AND floor(sun_azimuth+0.5)<292.5 THEN 'W'
  WHEN floor(sun_azimuth+0.5)>=292.5 AND floor(sun_azimuth+0.5)<337.5 THEN 'NW' ELSE 'N' END AS compass FROM z""")
def f20(spark, sf):
    b = _verts(spark, sf).join(routes(spark, sf), "route_id").withColumn(
        "elevation_m", ((F.col("route_id") * 37) % 3000).cast("double"))
    s = solar.with_compact_sun(b, "lat", "lng", "start_ms")
    s = s.withColumns({"pressure_pa": solar.pressure_pa("elevation_m"), "etr": solar.extraterrestrial_w_m2("start_ms"),
                       "delta_t": solar.delta_t_seconds("start_ms"), "zenith": 90.0 - F.col("sun_altitude")})
    s = s.withColumns({"airmass": solar.relative_airmass("zenith"), "compass": solar.compass_label("sun_azimuth")})
    s = solar.with_clear_sky(s, "zenith", "start_ms", F.col("pressure_pa"))
    out = rounded(rounded(rounded(s, 5, "sun_azimuth", "sun_altitude", "etr", "delta_t"), 3, "pressure_pa", "ghi"), 6, "airmass")
    return out.select("route_id", "v_idx", "sun_azimuth", "sun_altitude", "pressure_pa", "etr", "delta_t", "airmass", "ghi", "compass")


@query("F29_geometric_fallbacks", f"""{BOTH},
s AS ({S.exposed()})
SELECT route_id, seg_idx, round(CASE WHEN sun_altitude>0 THEN greatest(0,least(1,sin(radians(sun_altitude)))) ELSE 0 END,6) AS intensity,
 round((CASE WHEN sun_altitude>0 THEN greatest(0,least(1,sin(radians(sun_altitude)))) ELSE 0 END)*(1-CAST(seg_idx%3 AS DOUBLE)/2),6) AS exposure,
 round(CASE WHEN sun_altitude>0 AND {S.angle('heading', 'sun_azimuth')}<90 THEN greatest(0,cos(radians({S.angle('heading', 'sun_azimuth')}))*cos(radians(sun_altitude))) ELSE 0 END,6) AS glare FROM s""")
def f29(spark, sf):
    s = _exposed(spark, sf).withColumn("intensity", solar.geometric_intensity("sun_altitude"))
    s = s.withColumns({"exposure": solar.geometric_exposure("intensity", (F.col("seg_idx") % 3).cast("double") / 2),
                       "glare": solar.geometric_glare("heading", "sun_azimuth", "sun_altitude")})
    return rounded(s, 6, "intensity", "exposure", "glare").select("route_id", "seg_idx", "intensity", "exposure", "glare")


@query("F31_day_times", f"""{BOTH},
v AS (SELECT route_id, v_idx, lat, lng, CAST(floor(start_ms/86400000.0::DOUBLE) AS BIGINT) dd FROM fx_route_vertices JOIN fx_routes USING (route_id)),
a AS (SELECT *, radians(floor(lat*100+0.5)/100) phi, -radians(floor(lng*100+0.5)/100) lw, dd*86400000 mid FROM v),
b AS (SELECT *, floor((mid+43200000)/86400000.0::DOUBLE-0.5+2440588-2451545-0.0009-lw/(2*pi())+0.5) n FROM a),
c AS (SELECT *, 0.0009+lw/(2*pi())+n ds FROM b), d AS (SELECT *, radians(357.5291::DOUBLE+0.98560028::DOUBLE*ds) m FROM c),
e AS (SELECT *, m+radians(1.9148*sin(m)+0.02*sin(2*m)+0.0003*sin(3*m))+radians(102.9372)+pi() l FROM d),
f AS (SELECT *, asin(sin(radians(23.4397))*sin(l)) de, 2451545.0::DOUBLE+ds+0.0053*sin(m)-0.0069*sin(2*l) nj FROM e),
g AS (SELECT *, (sin(radians(-0.833))-sin(phi)*sin(de))/(cos(phi)*cos(de)) cw FROM f),
h AS (SELECT *, CASE WHEN abs(cw)<=1 THEN 2451545.0::DOUBLE+0.0009+(acos(greatest(-1,least(1,cw)))+lw)/(2*pi())+n+0.0053*sin(m)-0.0069*sin(2*l) END sj FROM g)
SELECT route_id, v_idx, CAST(CASE WHEN sj IS NULL THEN mid+21600000 ELSE floor((2*nj-sj+0.5-2440588)*86400000.0/60000+0.5)*60000 END AS BIGINT) AS sunrise_ms,
 CAST(CASE WHEN sj IS NULL THEN floor((nj+0.5-2440588)*86400000.0) ELSE floor((nj+0.5-2440588)*86400000.0/60000+0.5)*60000 END AS BIGINT) AS noon_ms,
 CAST(CASE WHEN sj IS NULL THEN mid+70200000 ELSE floor((sj+0.5-2440588)*86400000.0/60000+0.5)*60000 END AS BIGINT) AS sunset_ms FROM h""")
def f31(spark, sf):
    v = _verts(spark, sf).join(routes(spark, sf), "route_id").withColumn("day", solar.utc_date("start_ms"))
    return solar.with_day_times(v, "day", "lat", "lng").select("route_id", "v_idx", "sunrise_ms", "noon_ms", "sunset_ms")


LAT2, LNG2 = S.dest("lat", "lng", "brg", "m")


@query("F3_F7_geometry", f"""{VERTS},
a AS (SELECT *, CAST((route_id*47)%360 AS DOUBLE) brg, CAST((route_id*91)%5000 AS DOUBLE) m FROM fx_route_vertices),
b AS (SELECT *, {LAT2} dlat, {LNG2} dlng FROM a),
c AS (SELECT *, radians(lng+74)*6371000*cos(radians(42)) gx, radians(lat-41)*6371000 gy FROM b)
SELECT route_id, v_idx, round(dlat,6) AS dest_lat, round(dlng,6) AS dest_lng, round({S.angle('brg', '270')},5) AS turn,
 round(radians(dlng-lng)*6371000*cos(radians(lat)),2) AS px, round(radians(dlat-lat)*6371000,2) AS py,
 CAST(floor(gx/5000) AS BIGINT) AS tx, CAST(floor(gy/5000) AS BIGINT) AS ty,
 concat(CAST(floor(gx/5000) AS BIGINT),':',CAST(floor(gy/5000) AS BIGINT)) AS tile,
 round(41+degrees(floor(gy/5000)*5000/6371000.0),6) AS south,
 round({S.hav('dlat', 'dlng', f"lat+0.001*{S.frac('dlat', 'dlng', 'lat', 'lng', 'lat+0.001', 'lng')}", 'lng')},3) AS to_line_m FROM c""")
def f3(spark, sf):
    a = _verts(spark, sf).withColumns({"brg": ((F.col("route_id") * 47) % 360).cast("double"),
                                       "m": ((F.col("route_id") * 91) % 5000).cast("double")})
    lat, lng = geo.destination("lat", "lng", "brg", "m")
    a = a.withColumns({"dest_lat": lat, "dest_lng": lng})
    px, py = geo.project("dest_lat", "dest_lng", "lat", "lng")
    tx, ty = geo.tile_of("lat", "lng")
    a = a.withColumns({"px": px, "py": py, "tx": tx, "ty": ty, "turn": geo.angle_between("brg", 270.0)})
    a = a.withColumns({"tile": geo.tile_key("tx", "ty"), "south": geo.tile_bounds("tx", "ty")[0],
                       "to_line_m": geo.point_segment_m("dest_lat", "dest_lng", "lat", "lng", F.col("lat") + 0.001, "lng")})
    a = rounded(rounded(rounded(rounded(a, 6, "dest_lat", "dest_lng", "south"), 5, "turn"), 2, "px", "py"), 3, "to_line_m")
    return a.select("route_id", "v_idx", "dest_lat", "dest_lng", "turn", "px", "py", "tx", "ty", "tile", "south", "to_line_m")


@query("F40_W10_even_samples", f"""{VERTS},
r AS ({S.running()}), n AS (SELECT route_id, max(seg_idx) ls, max(total_m) tm FROM r GROUP BY 1),
short AS (SELECT v.route_id, v.v_idx sample_idx, lat, lng FROM fx_route_vertices v JOIN n USING (route_id) WHERE ls+2<=4),
t AS (SELECT route_id, CAST(i AS BIGINT) sample_idx, tm*i/3.0::DOUBLE tg FROM n, range(4) x(i) WHERE ls+2>4),
h AS (SELECT t.route_id, sample_idx, lat1, lng1, lat2, lng2, (least(tg,tm)-start_m)/seg_m f FROM t JOIN n USING (route_id) JOIN r ON r.route_id=t.route_id
 AND least(tg,tm)<=end_m+CASE WHEN seg_idx=ls THEN 1e-6 ELSE 0 END AND (least(tg,tm)>end_m-seg_m OR seg_idx=0)
 QUALIFY row_number() OVER (PARTITION BY t.route_id, sample_idx ORDER BY seg_idx)=1)
SELECT route_id, sample_idx, round(lat,6) AS lat, round(lng,6) AS lng FROM short
UNION ALL SELECT route_id, sample_idx, round(lat1+(lat2-lat1)*f,6), round(lng1+(lng2-lng1)*f,6) FROM h""")
def f40(spark, sf):
    return rounded(similarity.sample_routes(_running(spark, sf), 4), 6, "lat", "lng")


@query("W11_T7_precision_geometry", f"""{VERTS},
r AS MATERIALIZED (SELECT route_id, seg_idx, seg_m, heading, end_m, total_m FROM ({S.running()})),
b AS (SELECT route_id, max(total_m) tm, max(seg_idx)+2 mp FROM r GROUP BY 1 HAVING max(total_m)>0),
tu AS (SELECT * FROM (SELECT route_id, end_m c, total_m tm, {S.angle('heading', 'lead(heading) OVER (PARTITION BY route_id ORDER BY seg_idx)')} a FROM r) WHERE a>=18),
req AS (SELECT route_id, 0.0::DOUBLE d FROM b UNION SELECT route_id, tm FROM b UNION SELECT route_id, c FROM tu),
al AS (SELECT * FROM req UNION SELECT route_id, greatest(0,c-25) FROM tu UNION SELECT route_id, least(tm,c+25) FROM tu
 UNION SELECT route_id, CAST(i*50 AS DOUBLE) FROM (SELECT route_id, tm, unnest(range(1,CAST(ceil(tm/50) AS BIGINT)+1)) i FROM b) WHERE i*50<tm),
ks AS (SELECT route_id, d FROM (SELECT *, lag(d) OVER (PARTITION BY route_id ORDER BY d) p FROM al) WHERE p IS NULL OR d-p>=0.25),
kr AS (SELECT route_id, d, row_number() OVER (PARTITION BY route_id ORDER BY d)-1 k, count(*) OVER (PARTITION BY route_id) n
 FROM (SELECT *, lag(d) OVER (PARTITION BY route_id ORDER BY d) p FROM req) WHERE p IS NULL OR d-p>=0.25),
nn AS (SELECT route_id, count(*) na FROM ks GROUP BY 1),
wm AS (SELECT route_id, count(*) nm FROM kr GROUP BY 1),
opt AS (SELECT ks.route_id, ks.d, row_number() OVER (PARTITION BY ks.route_id ORDER BY ks.d)-1 k, count(*) OVER (PARTITION BY ks.route_id) n
 FROM ks LEFT JOIN kr ON kr.route_id=ks.route_id AND kr.d=ks.d WHERE kr.d IS NULL),
pk AS (SELECT DISTINCT b.route_id, floor(i*(o.n-1)/greatest(1,b.mp-nm-1)::DOUBLE+0.5) k FROM b JOIN wm USING (route_id) JOIN nn USING (route_id)
 JOIN (SELECT DISTINCT route_id, n FROM opt) o USING (route_id), LATERAL (SELECT unnest(range(0,greatest(0,b.mp-nm))) i) WHERE na>mp),
fin AS (SELECT ks.route_id, d FROM ks JOIN nn USING (route_id) JOIN b USING (route_id) WHERE na<=mp
 UNION ALL SELECT kr.route_id, d FROM kr JOIN nn USING (route_id) JOIN b USING (route_id) WHERE na>mp
 UNION ALL SELECT opt.route_id, d FROM opt JOIN pk ON pk.route_id=opt.route_id AND pk.k=opt.k)
SELECT route_id, row_number() OVER (PARTITION BY route_id ORDER BY d)-1 AS v_idx, round(d,3) AS target_m FROM fin""")
def w11(spark, sf):
    out = resample.resample(_running(spark, sf))
    return out.select("route_id", F.col("v_idx").cast("long").alias("v_idx"), F.round("target_m", 3).alias("target_m"))


@query("J12_map_back", f"""{VERTS},
r AS (SELECT route_id, seg_idx, start_m, end_m, total_m FROM ({S.running()})),
p AS (SELECT route_id, i, i*40.0::DOUBLE lo, least((i+1)*40.0,total_m) hi, total_m FROM (SELECT route_id, total_m, unnest(range(0,CAST(ceil(total_m/40) AS BIGINT))) i
 FROM (SELECT DISTINCT route_id, max(total_m) OVER (PARTITION BY route_id) total_m FROM r)))
SELECT r.route_id, seg_idx, CAST(i AS BIGINT) AS piece FROM r JOIN p ON p.route_id=r.route_id AND ((start_m+end_m)/2>lo OR i=0) AND ((start_m+end_m)/2<=hi OR hi=p.total_m)
QUALIFY row_number() OVER (PARTITION BY r.route_id, seg_idx ORDER BY i)=1""")
def j12(spark, sf):
    run = _running(spark, sf)
    whole = run.filter("seg_idx = 0").select("route_id", "total_m")
    n = F.ceil(F.col("total_m") / 40.0).cast("int")
    pieces = whole.filter("total_m > 0").withColumn("piece", F.explode(F.sequence(F.lit(0), n - 1)))
    pieces = pieces.select("route_id", F.col("piece").cast("long").alias("piece"), (F.col("piece") * 40.0).alias("lo_m"),
                           F.least((F.col("piece") + 1) * 40.0, F.col("total_m")).alias("hi_m"))
    return resample.map_back(run, pieces, ["piece"])


OFFSET = "SELECT route_id*1000+v_idx AS point_id, route_id, lat+0.0003*(v_idx%3) AS lat, lng-0.0002*(v_idx%2) AS lng FROM fx_route_vertices"


def _points(spark, sf):
    return _verts(spark, sf).select((F.col("route_id") * 1000 + F.col("v_idx")).alias("point_id"), "route_id",
                                    (F.col("lat") + 0.0003 * (F.col("v_idx") % 3)).alias("lat"),
                                    (F.col("lng") - 0.0002 * (F.col("v_idx") % 2)).alias("lng"))


@query("J14_J15_J28_nearest_segment", f"""{VERTS},
s AS (SELECT route_id, seg_idx, lat1, lng1, lat2, lng2, start_m, seg_m FROM ({S.running()})), p AS ({OFFSET}),
a AS (SELECT point_id, seg_idx, lat, lng, lat1, lng1, lat2, lng2, start_m, seg_m, {S.frac('lat', 'lng', 'lat1', 'lng1', 'lat2', 'lng2')} t FROM p JOIN s USING (route_id)),
d AS (SELECT *, {S.hav('lat', 'lng', 'lat1+(lat2-lat1)*t', 'lng1+(lng2-lng1)*t')} m FROM a)
SELECT point_id, round(m,3) AS distance, m<=40 AS snapped, round(start_m+seg_m*t,2) AS route_m FROM d QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY round(m,6), seg_idx)=1""")
def j14(spark, sf):
    near = nearest_segment(_points(spark, sf), _running(spark, sf), carry=["start_m", "seg_m"])
    out = near.withColumns({"snapped": F.col("distance") <= 40, "route_m": F.col("start_m") + F.col("seg_m") * F.col("t")})
    return rounded(rounded(out, 3, "distance"), 2, "route_m").select("point_id", "distance", "snapped", "route_m")


COPIES = """c AS (SELECT route_id, 2*route_id AS cid, v_idx, lat, lng FROM fx_route_vertices UNION ALL
 SELECT route_id, 2*route_id+1, v_idx, lat+0.0002, lng FROM fx_route_vertices)"""


@query("A3_A4_J13_similar_pairs", f"""{cte('fx_route_vertices', 'fx_routes')}, {COPIES},
s AS (SELECT cid, sum({S.hav('lat', 'lng', 'la', 'ln')}) dm FROM (SELECT *, lead(lat) OVER w la, lead(lng) OVER w ln FROM c WINDOW w AS (PARTITION BY cid ORDER BY v_idx)) WHERE la IS NOT NULL GROUP BY 1),
k AS (SELECT s.cid, dm, duration_sec+s.cid%2 du, route_id//50 od FROM s JOIN fx_routes ON route_id=s.cid//2),
p AS (SELECT a.od, a.cid i, b.cid j FROM k a JOIN k b ON a.od=b.od AND a.cid<b.cid AND abs(a.dm-b.dm)<80 AND abs(a.du-b.du)<15),
x AS (SELECT p.*, a.v_idx va, b.v_idx vb, {S.hav('a.lat', 'a.lng', 'b.lat', 'b.lng')} m FROM p JOIN c a ON a.cid=i JOIN c b ON b.cid=j),
u AS (SELECT od, i, j, max(mm) h, avg(CASE WHEN mm<=80 THEN 1.0 ELSE 0 END) o FROM (SELECT od, i, j, va, min(m) mm FROM x GROUP BY ALL) GROUP BY ALL),
w AS (SELECT od, i, j, max(mm) h, avg(CASE WHEN mm<=80 THEN 1.0 ELSE 0 END) o FROM (SELECT od, i, j, vb, min(m) mm FROM x GROUP BY ALL) GROUP BY ALL)
SELECT od AS od_id, i AS a_route_id, j AS b_route_id, round(greatest(u.h,w.h),3) AS hausdorff_m, round(least(u.o,w.o),6) AS overlap
FROM u JOIN w USING (od, i, j) WHERE greatest(u.h,w.h)<=100 AND least(u.o,w.o)>=0.8""")
def a3(spark, sf):
    out = similarity.similar_pairs(_copied_candidates(spark, sf))
    return rounded(rounded(out, 3, "hausdorff_m"), 6, "overlap").select(
        "od_id", "a_route_id", "b_route_id", "hausdorff_m", "overlap")


def _copied_candidates(spark, sf):
    v = _verts(spark, sf)
    twin = v.select((F.col("route_id") * 2 + 1).alias("route_id"), "v_idx",
                                                (F.col("lat") + 0.0002).alias("lat"), "lng")
    both = v.select((F.col("route_id") * 2).alias("route_id"), "v_idx", "lat", "lng").unionByName(twin)
    run = paths.with_running_m(paths.route_segments(both), last=True)
    arrays = similarity.sample_arrays(similarity.sample_routes(run))
    size = run.filter("seg_idx = 0").select("route_id", F.col("total_m").alias("distance_m"))
    meta = routes(spark, sf).select(F.col("route_id").alias("_r"), "duration_sec")
    out = size.join(arrays, "route_id").withColumn("_r", F.floor(F.col("route_id") / 2)).join(meta, "_r")
    return out.select(F.floor(F.col("_r") / 50).alias("od_id"), F.col("route_id").alias("candidate_index"), "route_id",
                      "distance_m", (F.col("duration_sec") + F.col("route_id") % 2).alias("duration_sec"), "samples")


@query("J13_distinct_candidates")
def j13(spark, sf):
    return similarity.keep_distinct(_copied_candidates(spark, sf)).select("od_id", "candidate_index", "route_id")


@query("F19_keys", f"""{VERTS},
e AS (SELECT route_id, arg_min(lat,v_idx) a, arg_min(lng,v_idx) b, arg_max(lat,v_idx) c, arg_max(lng,v_idx) d FROM fx_route_vertices GROUP BY 1)
SELECT route_id, concat(printf('%.5f',a),',',printf('%.5f',b)) AS point_key, concat(printf('%.3f',a),',',printf('%.3f',b)) AS cell,
 concat(printf('%.6f',a),',',printf('%.6f',b),'|',printf('%.6f',c),',',printf('%.6f',d),'|shade|',CASE WHEN route_id%2=0 THEN 'toll-free' ELSE 'standard' END,'|realtime') AS request_key,
 sha256(concat(printf('%.5f',a),',',printf('%.5f',b))) AS compact FROM e""")
def f19(spark, sf):
    v = _verts(spark, sf)
    e = v.groupBy("route_id").agg(F.min_by(F.struct("lat", "lng"), "v_idx").alias("s"), F.max_by(F.struct("lat", "lng"), "v_idx").alias("e"))
    start, end = (F.col("s.lat"), F.col("s.lng")), (F.col("e.lat"), F.col("e.lng"))
    point = keys.quantize_point(*start)
    return e.select("route_id", point.alias("point_key"), keys.country_cell(*start).alias("cell"),
                    keys.route_request_key(start, end, F.lit("shade"), F.col("route_id") % 2 == 0).alias("request_key"),
                    keys.compact_id(point).alias("compact"))


@query("F19_route_identity", f"""{BOTH},
q AS ({S.running()}), n AS (SELECT route_id, count(*)+1 nv, max(total_m) dm FROM q GROUP BY 1),
sm AS (SELECT route_id, v_idx k, lat, lng FROM fx_route_vertices JOIN n USING (route_id) WHERE nv<=12 UNION ALL
 SELECT route_id, k, lat1+(lat2-lat1)*f, lng1+(lng2-lng1)*f FROM (SELECT route_id, k, lat1, lat2, lng1, lng2, CASE WHEN seg_m>0 THEN (dm*k/11.0::DOUBLE-start_m)/seg_m ELSE 0 END f,
  row_number() OVER (PARTITION BY route_id, k ORDER BY seg_idx) rn FROM q JOIN n USING (route_id), range(12) t(k) WHERE nv>12 AND dm*k/11.0::DOUBLE<=end_m+1e-9) WHERE rn=1),
e AS (SELECT route_id, arg_min(lat,v_idx) a, arg_min(lng,v_idx) b, arg_max(lat,v_idx) c, arg_max(lng,v_idx) d FROM fx_route_vertices GROUP BY 1),
g AS (SELECT route_id, string_agg(concat(printf('%.4f',lng),',',printf('%.4f',lat)),';' ORDER BY k) g FROM sm GROUP BY 1)
SELECT route_id, concat('route-',printf('%.5f',round(dm,3)),'-',printf('%.5f',duration_sec),'-',printf('%.5f',b),'-',printf('%.5f',a),'-',printf('%.5f',d),'-',printf('%.5f',c),'-',g) AS identity
FROM e JOIN n USING (route_id) JOIN g USING (route_id) JOIN fx_routes USING (route_id)""")
def f19b(spark, sf):
    run = paths.with_running_m(paths.route_segments(_verts(spark, sf)), last=True)
    arrays = similarity.sample_arrays(similarity.sample_routes(run, keys.IDENTITY_SAMPLES))
    v = _verts(spark, sf)
    e = v.groupBy("route_id").agg(F.min_by(F.struct("lat", "lng"), "v_idx").alias("s"), F.max_by(F.struct("lat", "lng"), "v_idx").alias("e"))
    rows = e.join(arrays, "route_id").join(run.filter("seg_idx = 0").select("route_id", "total_m"), "route_id").join(routes(spark, sf), "route_id")
    # The length is rounded to millimetres: its fifth decimal is below the engines' agreement.
    text = keys.route_identity(F.round("total_m", 3), "duration_sec", (F.col("s.lng"), F.col("s.lat")), (F.col("e.lng"), F.col("e.lat")),
                               keys.geometry_signature("samples"), "route_id")
    return rows.select("route_id", text.alias("identity"))


@query("D1_spa_position")
def d1(spark, sf):
    v = _verts(spark, sf).join(routes(spark, sf), "route_id")
    out = with_spa_sun(v, "lat", "lng", "start_ms")
    return rounded(out, 6, "sun_azimuth", "sun_altitude", "geometric_altitude", "zenith", "earth_radius_au").select(
        "route_id", "v_idx", "sun_azimuth", "sun_altitude", "geometric_altitude", "zenith", "earth_radius_au")


@query("D2_spa_day_times")
def d2(spark, sf):
    v = _verts(spark, sf).join(routes(spark, sf), "route_id").withColumn("day", solar.utc_date("start_ms"))
    return rounded(with_spa_day_times(v, "day", "lat", "lng"), 5, "transit_hour", "sunrise_hour", "sunset_hour").select(
        "route_id", "v_idx", "transit_hour", "sunrise_hour", "sunset_hour")


@query("A1_spa_route_analysis")
def a1_spa(spark, sf):
    out = analysis.analyze_routes(_verts(spark, sf), routes(spark, sf), "spa")
    return rounded(out, 6, "avg_glare", "avg_shade", "direct_wh", "sunlit_s").select(
        "route_id", "avg_glare", "avg_shade", "direct_wh", "sunlit_s")
