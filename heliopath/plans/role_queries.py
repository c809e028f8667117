"""Candidate comparison, study and place queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import osm, places
from ..operators import analysis, roads, roles, study
from . import sqltext as S
from .registry import query, rounded
from .views import cte, ntz_ms, table, view

CAND = cte("fx_route_candidates")
TRADE = """f AS (SELECT * FROM fx_route_candidates QUALIFY row_number() OVER (PARTITION BY od_id ORDER BY duration_sec, candidate_index)=1),
t AS (SELECT c.*, f.route_id f_route_id, f.duration_sec fd, f.direct_wh fw, f.sunlit_s fs, c.route_id=f.route_id is_fastest, c.duration_sec/f.duration_sec detour_ratio,
 greatest(0,c.duration_sec-f.duration_sec) extra_s, f.avg_glare-c.avg_glare glare_gain,
 CASE WHEN f.direct_wh>0.00001 THEN greatest(0,(f.direct_wh-c.direct_wh)/f.direct_wh*100) ELSE 0 END energy_cut_pct, c.shade-f.shade shade_gain,
 f.sunlit_s-c.sunlit_s sunlit_saved_s, CASE WHEN f.sunlit_s>0.5 THEN greatest(0,(f.sunlit_s-c.sunlit_s)/f.sunlit_s*100) ELSE 0 END sunlit_saved_pct
 FROM fx_route_candidates c JOIN f USING (od_id))"""
GLARE = "(detour_ratio<=1.35 AND glare_gain>=0.05::DOUBLE)"
SHADE = "(detour_ratio<=1.35 AND (sunlit_saved_s>=30 OR (abs(sunlit_saved_s)<=30 AND energy_cut_pct>=5)))"
PROMISE = f"(detour_ratio<=1.35 AND ({SHADE} OR energy_cut_pct>=5 OR shade_gain>=0.05::DOUBLE))"
ROLES = f"""g AS (SELECT od_id, route_id gr FROM t WHERE NOT is_fastest AND {GLARE} QUALIFY row_number() OVER (PARTITION BY od_id ORDER BY avg_glare, extra_s, candidate_index)=1),
b1 AS (SELECT *, min(sunlit_s) OVER (PARTITION BY od_id) ml FROM t WHERE NOT is_fastest AND {SHADE}),
b2 AS (SELECT *, min(direct_wh) OVER (PARTITION BY od_id) mw FROM b1 WHERE sunlit_s<=ml+30),
h AS (SELECT od_id, route_id sr FROM b2 WHERE direct_wh-mw<=0.000001 QUALIFY row_number() OVER (PARTITION BY od_id ORDER BY duration_sec, candidate_index)=1),
roles AS (SELECT f.od_id, f.route_id fastest_route_id, coalesce(gr,f.route_id) glare_route_id, coalesce(sr,f.route_id) shade_route_id FROM f LEFT JOIN g USING (od_id) LEFT JOIN h USING (od_id))"""


def _cand(spark, sf):
    return view(spark, sf, "fx_route_candidates")


@query("P3_duration_ceiling", f"""{CAND}
SELECT od_id, route_id FROM fx_route_candidates QUALIFY duration_sec<=1.6*min(duration_sec) OVER (PARTITION BY od_id)""")
def p3(spark, sf):
    return roles.within_duration_ceiling(_cand(spark, sf)).select("od_id", "route_id")


@query("T1_T2_fastest", f"""{CAND}
SELECT od_id, route_id, duration_sec FROM fx_route_candidates QUALIFY row_number() OVER (PARTITION BY od_id ORDER BY duration_sec, candidate_index)=1""")
def t2(spark, sf):
    return roles.fastest(_cand(spark, sf)).select("od_id", "route_id", "duration_sec")


@query("J22_P6_P7_P8_tradeoffs", f"""{CAND}, {TRADE}
SELECT od_id, route_id, round(detour_ratio,9) AS detour_ratio, extra_s, round(glare_gain,6) AS glare_gain, round(energy_cut_pct,6) AS energy_cut_pct,
 round(sunlit_saved_s,6) AS sunlit_saved_s, round(sunlit_saved_pct,6) AS sunlit_saved_pct, {GLARE} AS glare_ok, {SHADE} AS shade_ok, {PROMISE} AS promising FROM t""")
def j22(spark, sf):
    t = roles.tradeoffs(_cand(spark, sf)).withColumns({
        "glare_ok": roles.meaningful_glare(), "shade_ok": roles.meaningful_shade(), "promising": roles.promising_shade()})
    names = ["detour_ratio", "glare_gain", "energy_cut_pct", "sunlit_saved_s", "sunlit_saved_pct"]
    return rounded(rounded(t, 9, "detour_ratio"), 6, *names[1:]).select("od_id", "route_id", "extra_s", *names, "glare_ok", "shade_ok", "promising")


@query("T3_roles", f"{CAND}, {TRADE}, {ROLES} SELECT * FROM roles")
def t3(spark, sf):
    return roles.select_roles(_cand(spark, sf))


@query("T4_precision_shortlist", f"""{CAND}, {TRADE}, {ROLES},
g2 AS (SELECT od_id, route_id, row_number() OVER (PARTITION BY od_id ORDER BY avg_glare, candidate_index) n FROM t WHERE is_fastest OR {GLARE} QUALIFY n<=2),
s2 AS (SELECT od_id, route_id, is_fastest, row_number() OVER (PARTITION BY od_id ORDER BY round(direct_wh,3), shade DESC, candidate_index) n FROM t WHERE is_fastest OR {PROMISE} QUALIFY n<=2),
u AS (SELECT od_id, coalesce((SELECT arg_min(route_id,n) FROM s2 WHERE s2.od_id=r.od_id AND NOT is_fastest),shade_route_id) route_id, 0 p FROM roles r
 UNION ALL SELECT od_id, fastest_route_id, 1 FROM roles UNION ALL SELECT od_id, glare_route_id, 2 FROM roles
 UNION ALL SELECT od_id, route_id, n+2 FROM g2 UNION ALL SELECT od_id, route_id, n+4 FROM s2),
m AS (SELECT od_id, route_id, min(p) p FROM u GROUP BY ALL)
SELECT od_id, route_id, row_number() OVER (PARTITION BY od_id ORDER BY p) AS priority FROM m QUALIFY priority<=5""")
def t4(spark, sf):
    out = roles.precision_shortlist(_cand(spark, sf), preferred="shade")
    return out.select("od_id", "route_id", F.col("priority").cast("long").alias("priority"))


@query("T5_best_available", f"""{CAND}, {TRADE}
SELECT t.od_id, t.route_id AS best_route_id, t.direct_wh AS best_wh FROM t JOIN f USING (od_id) WHERE t.duration_sec<=f.duration_sec*1.35 AND t.analysis_mode=f.analysis_mode
QUALIFY row_number() OVER (PARTITION BY t.od_id ORDER BY t.direct_wh, t.candidate_index)=1""")
def t5(spark, sf):
    return roles.best_available(_cand(spark, sf))


def cut_sql(role: str) -> str:
    pct = f"((wf.direct_wh-w{role[0]}.direct_wh)/wf.direct_wh*100)"
    return (f"CASE WHEN wf.direct_wh>0.0001 AND {role}_route_id<>fastest_route_id AND {pct}>=1 "
            f"THEN least(99,floor({pct}+0.5)) ELSE 0 END AS {role}_cut_pct")


@query("A20_exposure_reductions", f"""{CAND}, {TRADE}, {ROLES}
SELECT r.*, {cut_sql('glare')}, {cut_sql('shade')}, NOT wf.direct_wh>0.0001 AS is_night FROM roles r JOIN fx_route_candidates wf ON wf.route_id=fastest_route_id
 JOIN fx_route_candidates wg ON wg.route_id=glare_route_id JOIN fx_route_candidates ws ON ws.route_id=shade_route_id""")
def a20(spark, sf):
    c = _cand(spark, sf)
    return roles.exposure_reductions(c, roles.select_roles(c))


REFINED = """rf AS (SELECT route_id, route_id%7<>0 ready, analysis_mode, avg_glare*0.9 avg_glare, sunlit_s*0.8 sunlit_s, direct_wh*0.85 direct_wh, shade FROM fx_route_candidates WHERE analysis_mode<>'heuristic')"""


@query("J23_comparable_tier", f"""{CAND}, {TRADE}, {REFINED},
bm AS (SELECT f.od_id, rf.analysis_mode bmode FROM f LEFT JOIN rf ON rf.route_id=f.route_id AND ready)
SELECT c.od_id, c.route_id, coalesce(bmode,'heuristic') AS analysis_mode, round(CASE WHEN bmode IS NULL THEN c.sunlit_s ELSE rf.sunlit_s END,6) AS sunlit_s,
 round(CASE WHEN bmode IS NULL THEN c.direct_wh ELSE rf.direct_wh END,6) AS direct_wh
FROM fx_route_candidates c JOIN bm USING (od_id) LEFT JOIN rf ON rf.route_id=c.route_id AND ready WHERE bmode IS NULL OR rf.analysis_mode=bmode""")
def j23(spark, sf):
    c = _cand(spark, sf)
    out = roles.comparable_tier(c, _refined(c))
    return rounded(out, 6, "sunlit_s", "direct_wh").select("od_id", "route_id", "analysis_mode", "sunlit_s", "direct_wh")


def _refined(c):
    return c.filter("analysis_mode <> 'heuristic'").select(
        "route_id", (F.col("route_id") % 7 != 0).alias("ready"), "analysis_mode", (F.col("avg_glare") * 0.9).alias("avg_glare"),
        (F.col("sunlit_s") * 0.8).alias("sunlit_s"), (F.col("direct_wh") * 0.85).alias("direct_wh"), "shade")


@query("D12_tiered_roles")
def d12(spark, sf):
    """Ceiling, shortlist, tier and roles in one plan over all ods."""
    return roles.compare_routes(_cand(spark, sf), _refined)


@query("A14_candidate_counts", f"""{CAND}, n AS (SELECT od_id, count(*) n FROM fx_route_candidates GROUP BY 1)
SELECT count(*) AS ods, CAST(sum(n) AS BIGINT) AS candidates, min(n) AS least, max(n) AS most, count(*) FILTER (WHERE n=1) AS single_candidate_ods FROM n""")
def a14(spark, sf):
    return study.candidate_counts(_cand(spark, sf))


@query("P19_fallback_metrics", f"""{CAND},
m AS (SELECT *, CASE WHEN route_id%5=0 THEN NULL ELSE sunlit_s END s, CASE WHEN route_id%3=0 THEN NULL ELSE sunlit_s/duration_sec END r,
 CASE WHEN route_id%4=0 THEN NULL ELSE direct_wh END w, CASE WHEN route_id%2=0 THEN NULL ELSE shade END c FROM fx_route_candidates),
e AS (SELECT *, coalesce(w,avg_glare,0) en FROM m)
SELECT route_id, round(en,6) AS energy, round(CASE WHEN s>=0 THEN s WHEN r>=0 THEN r*duration_sec WHEN en>0 THEN duration_sec ELSE 0 END,5) AS sunlit,
 CASE WHEN analysis_mode IN ('scene','hybrid-scene') AND c IS NOT NULL THEN c ELSE coalesce(shade,0) END AS metric FROM e""")
def p19(spark, sf):
    k = F.col("route_id")
    m = _cand(spark, sf).withColumns({
        "s": F.when(k % 5 != 0, F.col("sunlit_s")), "r": F.when(k % 3 != 0, F.col("sunlit_s") / F.col("duration_sec")),
        "w": F.when(k % 4 != 0, F.col("direct_wh")), "c": F.when(k % 2 != 0, F.col("shade"))})
    m = m.withColumn("energy", roles.energy("w", "avg_glare"))
    m = m.withColumn("sunlit", roles.sunlit_seconds("s", "r", F.lit(None).cast("double"), "duration_sec", "energy"))
    m = m.withColumn("metric", roles.shade_metric("analysis_mode", "c", "shade"))
    return rounded(rounded(m, 6, "energy"), 5, "sunlit").select("route_id", "energy", "sunlit", "metric")


@query("F39_T13_via_points", f"""{cte('fx_route_vertices')},
o AS (SELECT route_id od_id, arg_min(lat,v_idx) a, arg_min(lng,v_idx) b, arg_max(lat,v_idx) c, arg_max(lng,v_idx) d, count(*) n FROM fx_route_vertices GROUP BY 1),
m AS (SELECT *, (a+c)/2 mla, (b+d)/2 mlo, -(d-b)/cos(radians((a+c)/2)) pa, (c-a)*cos(radians((a+c)/2)) po, sqrt((c-a)*(c-a)+(d-b)*(d-b)) sp FROM o),
q AS (SELECT *, CASE WHEN sqrt(pa*pa+po*po)=0 THEN 1 ELSE sqrt(pa*pa+po*po) END nm, least(0.015,greatest(0.0015,sp*0.18)) os FROM m)
SELECT od_id, CAST(v.no AS INTEGER) AS via_no, round(mla+v.sd*pa/nm*os*v.k,6) AS via_lat, round(mlo+v.sd*po/nm*os*v.k,6) AS via_lng
FROM q, (VALUES (1,1.0::DOUBLE,1.0::DOUBLE),(2,-1.0,1.0),(3,1.0,1.8),(4,-1.0,1.8)) v(no,sd,k) WHERE v.no<=CASE WHEN n>=3 THEN 0 ELSE 2 END""")
def f39(spark, sf):
    v = view(spark, sf, "fx_route_vertices")
    o = v.groupBy(F.col("route_id").alias("od_id")).agg(F.min_by(F.struct("lat", "lng"), "v_idx").alias("s"),
                                                        F.max_by(F.struct("lat", "lng"), "v_idx").alias("e"), F.count("*").alias("n"))
    o = o.select("od_id", "n", F.col("s.lat").alias("lat1"), F.col("s.lng").alias("lng1"), F.col("e.lat").alias("lat2"), F.col("e.lng").alias("lng2"))
    # The number of vertices stands in for the number of distinct direct routes.
    out = roles.via_points(o).join(o.select("od_id", roles.via_budget("n").alias("budget")), "od_id").filter("via_no <= budget")
    return rounded(out, 6, "via_lat", "via_lng").select("od_id", "via_no", "via_lat", "via_lng")


@query("P16_P17_cards", f"""{CAND}, {TRADE},
x AS (SELECT *, CAST(floor(duration_sec/60+0.5) AS BIGINT)-CAST(floor(fd/60+0.5) AS BIGINT) dm FROM t)
SELECT od_id, route_id, CASE WHEN dm>0 THEN concat('+',dm,'min detour') WHEN dm<0 THEN concat(dm,'min faster') ELSE 'Same as fastest' END AS detour_text,
 CASE WHEN analysis_mode='heuristic' THEN concat('Estimated shade potential ',CAST(floor(shade*100+0.5) AS BIGINT),'%') ELSE concat('Confirmed shade ',CAST(floor(shade*100+0.5) AS BIGINT),'%') END AS shade_text,
 concat('Estimated direct-sun exposure ',CASE WHEN sunlit_s>0 AND sunlit_s<60 THEN '<1 min' ELSE concat(CAST(floor(sunlit_s/60+0.5) AS BIGINT),' min') END,' (',CAST(floor(least(1,sunlit_s/duration_sec)*100+0.5) AS BIGINT),'%)') AS sun_text,
 CASE WHEN avg_glare>0.45::DOUBLE THEN 'glare' WHEN analysis_mode='scene' THEN 'confirmed-shade' WHEN analysis_mode='heuristic' AND shade>0.5 THEN 'estimated-shade' ELSE 'clear' END AS color_class FROM x""")
def p16(spark, sf):
    from ..operators import cards

    t = roles.tradeoffs(_cand(spark, sf))
    zero = F.lit(0.0)
    return t.select("od_id", "route_id", cards.detour_text("duration_sec", "f_duration_sec", zero, zero).alias("detour_text"),
                    cards.shade_text("analysis_mode", "shade", zero, "shade").alias("shade_text"),
                    cards.sunlit_text("sunlit_s", "duration_sec").alias("sun_text"),
                    cards.color_class("avg_glare", F.col("analysis_mode") == "scene",
                                      F.when(F.col("analysis_mode") == "heuristic", "estimated-shade"), "shade").alias("color_class"))


@query("P12_P21_scene_labels", f"""{CAND},
s AS (SELECT *, route_id%4<>0 ready, route_id%3=0 part, route_id%6 cov FROM fx_route_candidates),
m AS (SELECT *, CASE WHEN analysis_mode='heuristic' THEN 'heuristic' WHEN ready THEN 'scene' WHEN part AND cov>0 THEN 'hybrid-scene' ELSE 'heuristic' END md,
 CASE route_id%5 WHEN 0 THEN 'SCENE_TILE_MISSING' WHEN 1 THEN 'OTHER' WHEN 2 THEN 'NIGHT_SCENE_NOT_NEEDED' END rs FROM s)
SELECT route_id, md AS tier, CASE WHEN rs='NIGHT_SCENE_NOT_NEEDED' THEN 'Night · scene analysis not needed'
 WHEN md='hybrid-scene' THEN concat('Partial scene analysis (',CAST(floor(shade*100+0.5) AS BIGINT),'% of segments)')
 WHEN md='scene' THEN CASE WHEN part AND cov>0 THEN 'Building/terrain precision analysis' WHEN part THEN 'Building data applied · terrain unavailable' WHEN cov>2 THEN 'Tunnel data only' ELSE 'Scene data applied' END
 ELSE concat('Heuristic estimate',CASE rs WHEN 'SCENE_TILE_MISSING' THEN ' (scene tile not available)' WHEN 'OTHER' THEN ' (OTHER)' ELSE '' END,
  CASE WHEN floor(shade*100+0.5)>0 THEN concat(' · ',CAST(floor(shade*100+0.5) AS BIGINT),'% scene coverage retained') ELSE '' END) END AS label FROM m""")
def p21(spark, sf):
    from ..operators import cards

    k = F.col("route_id")
    s = _cand(spark, sf).withColumns({"ready": k % 4 != 0, "part": k % 3 == 0, "cov": k % 6})
    s = s.withColumn("tier", analysis.analysis_tier("ready", "part", "cov", F.col("analysis_mode") != "heuristic"))
    reason = F.when(k % 5 == 0, "SCENE_TILE_MISSING").when(k % 5 == 1, "OTHER").when(k % 5 == 2, "NIGHT_SCENE_NOT_NEEDED")
    return s.select("route_id", "tier", cards.scene_label("tier", reason, F.lit(False), "shade", "part", F.col("cov") > 0,
                                                          F.col("cov") > 2).alias("label"))


PLACE = cte("fx_place_results")
PLACEQ = """q AS (SELECT *, concat((query_id%30)+1,' red widget road') AS query, {hav}/1000 AS dist_km FROM fx_place_results)""".format(
    hav=S.hav("40.1", "-74.1", "lat", "lng"))
SCORE = """w AS (SELECT *, trim(regexp_replace(lower(query),'[^\\p{L}\\p{N}]+',' ','g')) nq, trim(regexp_replace(lower(concat(display_name,' ',house_number)),'[^\\p{L}\\p{N}]+',' ','g')) nt FROM q),
y AS (SELECT *, string_split(nq,' ') qt, string_split(nt,' ') tt FROM w),
z AS (SELECT *, CASE WHEN contains(nt,nq) THEN 100 ELSE 0 END+len(list_filter(qt,lambda k: list_contains(tt,k)))/len(qt)::DOUBLE*40
 +CASE WHEN CAST(house_number AS VARCHAR)=qt[1] THEN 80 ELSE 0 END-CASE WHEN NOT list_contains(tt,qt[1]) THEN 100 ELSE 0 END+importance AS sc FROM y)"""


def _places(spark, sf):
    from ..functions.geo import haversine_m

    p = view(spark, sf, "fx_place_results")
    return p.withColumns({"query": F.concat((F.col("query_id") % 30 + 1).cast("string"), F.lit(" red widget road")),
                          "dist_km": haversine_m(40.1, -74.1, "lat", "lng") / 1000.0,
                          "short_title": F.lit(""), "road": F.lit(""), "order_no": F.col("result_id")})


@query("F17_address_score", f"{PLACE}, {PLACEQ}, {SCORE} SELECT result_id, round(sc,5) AS match_score FROM z")
def f17(spark, sf):
    p = _places(spark, sf)
    return p.select("result_id", F.round(places.address_score(
        "query", ["short_title", "display_name", "house_number", "road"], "house_number", "importance"), 5).alias("match_score"))


@query("T6_place_ranking", f"""{PLACE}, {PLACEQ}, {SCORE}
SELECT query_id, result_id, row_number() OVER (PARTITION BY query_id ORDER BY source<>'nominatim', round(sc,3) DESC, dist_km, result_id) AS place_rank FROM z QUALIFY place_rank<=7""")
def t6(spark, sf):
    p = _places(spark, sf).withColumn("house_number", F.col("house_number").cast("string"))
    return roads.rank_places(p).select("query_id", "result_id", F.col("place_rank").cast("long").alias("place_rank"))


@query("X5_place_merge")
def x5(spark, sf):
    p = _places(spark, sf).withColumn("house_number", F.col("house_number").cast("string"))
    near = p.withColumns({"lat": F.floor(F.col("lat") * 100) / 100 + F.col("result_id") % 7 * 0.0002})
    return roads.merge_place_results(near).select("query_id", "result_id")


@query("T12_nearest_place", f"""{PLACE}, {PLACEQ}
SELECT query_id, result_id, round(dist_km,5) AS dist_km FROM q QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY dist_km, result_id)=1""")
def t12(spark, sf):
    return rounded(roads.nearest_place(_places(spark, sf)), 5, "dist_km")


@query("F18_short_address", f"""{PLACE}
SELECT result_id, CASE WHEN result_id%9=0 THEN concat(printf('%.4f',lat),', ',printf('%.4f',lng)) ELSE concat(source,', ',display_name,', ',query_id) END AS address FROM fx_place_results""")
def f18(spark, sf):
    name = F.when(F.col("result_id") % 9 != 0, F.concat_ws(" , ", "source", "display_name", F.col("query_id").cast("string"), F.lit("XX")))
    return view(spark, sf, "fx_place_results").select("result_id", places.short_address(name, "lat", "lng").alias("address"))


@query("J16_F15_country", f"""{cte('fx_gps_fixes')},
a AS (SELECT fix_id, (fix_id*7919)%18000/100.0::DOUBLE-90 lat, (fix_id*104729)%36000/100.0::DOUBLE-180 lng,
 CASE fix_id%11 WHEN 0 THEN ' usa ' WHEN 1 THEN 'uk' WHEN 2 THEN 'KOR' WHEN 3 THEN 'fr' WHEN 4 THEN 'x1' ELSE '' END code FROM fx_gps_fixes),
p AS (SELECT * FROM (VALUES {{polys}}) v(pn,i,x,y)),
e AS (SELECT a.pn, a.x ax, a.y ay, b.x bx, b.y by_ FROM p a JOIN p b ON a.pn=b.pn AND b.i=CASE WHEN a.i=0 THEN (SELECT max(i) FROM p c WHERE c.pn=a.pn) ELSE a.i-1 END),
h AS (SELECT fix_id, pn, count(*)%2=1 ins FROM a JOIN e ON (ay>lat)<>(by_>lat) AND lng<(bx-ax)*(lat-ay)/CASE WHEN by_-ay=0 THEN 2.2e-16 ELSE by_-ay END+ax GROUP BY 1,2),
k AS (SELECT a.*, coalesce((SELECT bool_or(ins) FROM h WHERE h.fix_id=a.fix_id AND pn<3),false) us, coalesce((SELECT bool_or(ins) FROM h WHERE h.fix_id=a.fix_id AND pn=3),false) gb FROM a)
SELECT fix_id, CASE trim(code) WHEN 'usa' THEN 'US' WHEN 'uk' THEN 'GB' WHEN 'KOR' THEN 'KR' WHEN 'fr' THEN 'FR' ELSE '' END AS normal,
 CASE WHEN trim(code)='usa' THEN 'US' WHEN code='uk' THEN 'GB' WHEN code='KOR' THEN 'KR' WHEN code<>'' THEN 'INT'
 WHEN NOT (lat>43.2 AND lat<46 AND lng>-83.5 AND lng<-77) AND (us OR (lat BETWEEN 18 AND 23 AND lng BETWEEN -161 AND -154)) THEN 'US'
 WHEN lat BETWEEN 33 AND 39 AND lng BETWEEN 124 AND 132 THEN 'KR' WHEN gb THEN 'GB' ELSE 'INT' END AS country FROM k""".replace("{polys}", ",".join(
    f"({n},{i},{x}::DOUBLE,{y}::DOUBLE)" for n, ring in enumerate(
        [places.CONTIGUOUS_US, places.ALASKA_MAINLAND, places.ALASKA_PANHANDLE, places.GREAT_BRITAIN])
    for i, (x, y) in enumerate(ring))))
def j16(spark, sf):
    k = F.col("fix_id")
    code = F.when(k % 11 == 0, " usa ").when(k % 11 == 1, "uk").when(k % 11 == 2, "KOR").when(k % 11 == 3, "fr").when(
        k % 11 == 4, "x1").otherwise("")
    a = view(spark, sf, "fx_gps_fixes").select("fix_id", ((k * 7919) % 18000 / 100.0 - 90).alias("lat"),
                                               ((k * 104729) % 36000 / 100.0 - 180).alias("lng"), code.alias("code"))
    return a.select("fix_id", places.normalize_country("code").alias("normal"), places.detect_country("lat", "lng", "code").alias("country"))


@query("F14_F16_road_tags", f"""{cte('fx_road_tags')},
n AS (SELECT *, try_cast(replace(nullif(regexp_extract(maxspeed,'[0-9]+([.,][0-9]+)?'),''),',','.') AS DOUBLE) v, coalesce(country IN ('US','GB'),false) imp FROM fx_road_tags),
m AS (SELECT *, v>0 AND v<=300 AND maxspeed NOT IN ('signals','none') ok, maxspeed LIKE '%mph' OR (maxspeed NOT LIKE '%km/h' AND imp) mph FROM n)
SELECT way_id, CASE WHEN ok THEN v END AS value, CASE WHEN ok THEN CASE WHEN mph THEN 'mph' ELSE 'km/h' END END AS source_unit,
 round(CASE WHEN ok THEN CASE WHEN mph THEN v*1.609344 ELSE v END END,6) AS speed_limit_kmh, CASE WHEN ok THEN CASE WHEN imp THEN 'mph' ELSE 'km/h' END END AS display_unit,
 highway IN ('motorway','motorway_link') AS is_motorway, toll='yes' AS is_toll FROM m""")
def f14(spark, sf):
    motorway, toll, _ = osm.road_flags("highway", "toll")
    r = view(spark, sf, "fx_road_tags").withColumn("_s", osm.max_speed("maxspeed", "country"))
    out = r.select("way_id", "_s.value", "_s.source_unit", "_s.speed_limit_kmh", "_s.display_unit",
                   motorway.alias("is_motorway"), toll.alias("is_toll"))
    return rounded(out, 6, "speed_limit_kmh")


@query("F12_F13_heights", f"""{cte('fx_buildings')},
a AS (SELECT *, CASE tag_height WHEN '12 m' THEN 12.0 WHEN '30 ft' THEN 9.144 END::DOUBLE h, CAST(tag_levels AS DOUBLE) l,
 CASE WHEN tag_min_height IS NOT NULL THEN 12 WHEN tag_min_level IS NOT NULL THEN round(CAST(tag_min_level AS DOUBLE)*3.2,3) ELSE 0 END mn,
 CASE WHEN tag_min_height IS NOT NULL THEN 12 WHEN tag_min_level IS NOT NULL THEN round(CAST(tag_min_level AS DOUBLE)*3,3) ELSE 0 END ml,
 CASE WHEN tag_min_height IS NOT NULL THEN 12 WHEN tag_min_level IS NOT NULL THEN round(CAST(tag_min_level AS DOUBLE)*4.5,3) ELSE 0 END mu,
 CASE WHEN tag_min_height IS NOT NULL THEN 'osm-min-height' WHEN tag_min_level IS NOT NULL THEN 'osm-building-min-level' ELSE 'ground' END ms FROM fx_buildings),
b AS (SELECT *, round(coalesce(h,mn+coalesce(l*3.2,6)),3) hn, round(coalesce(h,ml+coalesce(l*3,3)),3) hl, round(coalesce(h,mu+coalesce(l*4.5,12)),3) hu FROM a)
SELECT building_id, hn AS height, hl AS height_lower, hu AS height_upper, CASE WHEN h IS NOT NULL THEN 'osm-height' WHEN l IS NOT NULL THEN 'osm-building-levels' ELSE 'missing-height-default' END AS height_source,
 least(mn,hn) AS min_height, least(ml,hl) AS min_height_lower, least(mu,hu) AS min_height_upper,
 CASE WHEN mn>hn OR ml>hl OR mu>hu THEN concat(ms,'-clamped-to-height') ELSE ms END AS min_height_source FROM b""")
def f12(spark, sf):
    b = osm.with_height_model(view(spark, sf, "fx_buildings"), "tag_height", "tag_levels", "tag_min_height", "tag_min_level")
    return b.select("building_id", *osm.HEIGHT_COLUMNS).drop("height_estimated", "min_height_adjusted")


@query("W12_recent_destinations", """WITH v AS (SELECT user_id, event_type AS name, event_id, epoch_us(ts)//1000 ms FROM events),
n AS (SELECT user_id, name, max(ms) visit_ms FROM v GROUP BY ALL), g AS (SELECT user_id, max(ms)-3600000 removed_ms FROM v GROUP BY 1)
SELECT n.user_id, n.name, visit_ms, row_number() OVER (PARTITION BY n.user_id ORDER BY visit_ms DESC) AS place_no FROM n LEFT JOIN g ON g.user_id=n.user_id AND n.name='error'
WHERE removed_ms IS NULL OR visit_ms>removed_ms QUALIFY place_no<=8""")
def w12(spark, sf):
    e = table(spark, sf, "events").select("user_id", F.col("event_type").alias("name"), F.col("event_id").alias("visit_id"), ntz_ms("ts").alias("visit_ms"))
    gone = e.groupBy("user_id").agg((F.max("visit_ms") - 3600000).alias("removed_ms")).withColumn("name", F.lit("error"))
    return roads.recent_destinations(e, gone).select("user_id", "name", "visit_ms", F.col("place_no").cast("long").alias("place_no"))


@query("T10_last_entries", """SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS entry_no FROM events QUALIFY entry_no<=500""")
def t10(spark, sf):
    e = table(spark, sf, "events").select("user_id", F.col("event_id").alias("entry_id"), F.col("ts").alias("entry_ms"))
    return roads.last_entries(e, key="user_id").select("user_id", F.col("entry_id").alias("event_id"), F.col("entry_no").cast("long").alias("entry_no"))


@query("J30_country_by_cell", f"""{cte('fx_gps_fixes')},
a AS (SELECT fix_id, concat(printf('%.3f',lat),',',printf('%.3f',lng)) cell, CASE WHEN fix_id%5=0 THEN 'gbr' ELSE '' END code FROM fx_gps_fixes),
l AS (SELECT DISTINCT cell, CASE WHEN strpos(cell,'7')>0 THEN 'US' ELSE '' END lc FROM a)
SELECT fix_id, cell, CASE WHEN code<>'' THEN 'GB' ELSE nullif(lc,'') END AS country FROM a JOIN l USING (cell)""")
def j30(spark, sf):
    p = view(spark, sf, "fx_gps_fixes").select("fix_id", "lat", "lng", F.when(F.col("fix_id") % 5 == 0, "gbr").otherwise("").alias("country_code"))
    look = roads.cells_to_look_up(p).withColumn("code", F.when(F.col("cell").contains("7"), "us").otherwise(""))
    return roads.country_by_cell(p, look).select("fix_id", "cell", "country")


STUDY = f"""{CAND}, {TRADE}, {ROLES},
be AS (SELECT t.od_id, t.direct_wh bw FROM t JOIN f USING (od_id) WHERE t.duration_sec<=f.duration_sec*1.35 AND t.analysis_mode=f.analysis_mode
 QUALIFY row_number() OVER (PARTITION BY t.od_id ORDER BY t.direct_wh, t.candidate_index)=1),
tc AS (SELECT * FROM (VALUES ('summer-0800','summer',6,21,8),('summer-1300','summer',6,21,13),('summer-1800','summer',6,21,18),('winter-1300','winter',12,21,13)) v(time_case,season,m,d,h)),
st AS (SELECT r.od_id, time_case, CASE r.od_id%3 WHEN 0 THEN 'short' WHEN 1 THEN 'medium' ELSE 'long' END distance_class, concat('r',r.od_id%4) region, a.analysis_mode,
 date_diff('day',DATE '1970-01-01',make_date(2026,m,d))*86400000+(h-CASE season WHEN 'summer' THEN -(4+r.od_id%4) ELSE -(5+r.od_id%4) END)*3600000 start_ms,
 a.direct_wh fw2, b.direct_wh sw, greatest(0,a.direct_wh-b.direct_wh) avoided_wh, CASE WHEN a.direct_wh>0 THEN 100*greatest(0,a.direct_wh-b.direct_wh)/a.direct_wh ELSE 0 END reduction_pct,
 CASE WHEN a.direct_wh>0 THEN 100*greatest(0,a.direct_wh-bw)/a.direct_wh ELSE 0 END best_reduction_pct, greatest(0,(b.duration_sec-a.duration_sec)/60) detour_min
 FROM roles r JOIN fx_route_candidates a ON a.route_id=fastest_route_id JOIN fx_route_candidates b ON b.route_id=shade_route_id JOIN be ON be.od_id=r.od_id CROSS JOIN tc)"""


def _study(spark, sf):
    c = _cand(spark, sf)
    rl = roles.select_roles(c)
    for role in ("fastest", "shade"):
        rl = rl.join(c.select(F.col("route_id").alias(f"{role}_route_id"), F.col("direct_wh").alias(f"{role}_wh"),
                              F.col("duration_sec").alias(f"{role}_duration_sec"),
                              *([F.col("analysis_mode")] if role == "fastest" else [])), f"{role}_route_id")
    k = F.col("od_id")
    rows = rl.join(roles.best_available(c), "od_id").withColumns({
        "distance_class": F.when(k % 3 == 0, "short").when(k % 3 == 1, "medium").otherwise("long"),
        "region": F.concat(F.lit("r"), (k % 4).cast("string")), "summer_offset": -(4 + k % 4), "winter_offset": -(5 + k % 4)})
    return study.study_rows(study.time_case_rows(rows))


@query("D11_J24_F33_F34_study_rows", f"""{STUDY}
SELECT od_id, time_case, CAST(start_ms AS BIGINT) AS start_ms, round(avoided_wh,6) AS avoided_wh, round(reduction_pct,6) AS reduction_pct, round(best_reduction_pct,6) AS best_reduction_pct,
 round(detour_min,6) AS detour_min, round(avoided_wh*1.5*0.35/3.5,6) AS cooling_min_wh, round(avoided_wh*2*0.5/2.5,6) AS cooling_central_wh, round(avoided_wh*3*0.65/2,6) AS cooling_max_wh FROM st""")
def d11(spark, sf):
    names = ["avoided_wh", "reduction_pct", "best_reduction_pct", "detour_min", "cooling_min_wh", "cooling_central_wh", "cooling_max_wh"]
    return rounded(_study(spark, sf), 6, *names).select("od_id", "time_case", "start_ms", *names)


@query("A12_study_groups", f"""{STUDY}, k AS (SELECT * FROM st WHERE analysis_mode<>'heuristic')
SELECT 'distance_class' AS dimension, distance_class AS label, round(avg(best_reduction_pct),6) AS best_reduction_pct, round(avg(fw2),6) AS fastest_wh FROM k GROUP BY 2
UNION ALL SELECT 'time_case', time_case, round(avg(best_reduction_pct),6), round(avg(fw2),6) FROM k GROUP BY 2
UNION ALL SELECT 'region', region, round(avg(best_reduction_pct),6), round(avg(fw2),6) FROM k GROUP BY 2""")
def a12(spark, sf):
    out = study.study_groups(_study(spark, sf), ["distance_class", "time_case", "region"], ["best_reduction_pct", "fastest_wh"])
    return rounded(out, 6, "best_reduction_pct", "fastest_wh")


@query("A13_study_totals", f"""{STUDY}, k AS (SELECT *, row_number() OVER (ORDER BY reduction_pct)-1 i, count(*) OVER () n FROM st WHERE analysis_mode<>'heuristic')
SELECT (SELECT count(*) FROM st) AS total, count(*) AS precision_cases, round(avg(reduction_pct),6) AS mean_reduction, round(avg(best_reduction_pct),6) AS mean_best_reduction,
 count(*) FILTER (WHERE reduction_pct>0) AS positive, round(sum(avoided_wh),4) AS total_avoided_wh, round(sum(avoided_wh*2*0.5/2.5),4) AS total_cooling_central_wh,
 round(max(reduction_pct) FILTER (WHERE i=n//2),6) AS median_reduction FROM k""")
def a13(spark, sf):
    out = study.study_totals(_study(spark, sf))
    return rounded(rounded(out, 6, "mean_reduction", "mean_best_reduction", "median_reduction"), 4, "total_avoided_wh", "total_cooling_central_wh")


@query("X1_candidate_union", f"""{CAND}
SELECT od_id, route_id, CASE WHEN route_id%2=1 THEN 'via' ELSE 'direct' END AS origin,
 row_number() OVER (PARTITION BY od_id ORDER BY route_id%2, candidate_index)-1 AS candidate_index FROM fx_route_candidates""")
def x1(spark, sf):
    """Even routes stand for direct answers, odd ones for answers through a via point."""
    c = _cand(spark, sf)
    out = roles.candidate_union(c.filter("route_id % 2 = 0"), c.filter("route_id % 2 = 1"))
    return out.select("od_id", "route_id", "origin", "candidate_index")
