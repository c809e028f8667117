"""The oracle's formulas, as SQL text pieces."""

from __future__ import annotations

PI = "pi()"


def hav(a, b, c, d) -> str:
    h = (f"(pow(sin(radians({c}-({a}))/2),2)+cos(radians({a}))*cos(radians({c}))*pow(sin(radians({d}-({b}))/2),2))")
    return f"(2*6371000.0*atan2(sqrt({h}),sqrt(greatest(0,1-{h}))))"


def bearing(a, b, c, d) -> str:
    y = f"sin(radians({d}-({b})))*cos(radians({c}))"
    x = f"cos(radians({a}))*sin(radians({c}))-sin(radians({a}))*cos(radians({c}))*cos(radians({d}-({b})))"
    return f"fmod(degrees(atan2({y},{x}))+360,360)"


def angle(a, b) -> str:
    return f"abs(fmod(fmod({a}-({b}),360)+540,360)-180)"


def dest(lat, lng, brg, m) -> tuple[str, str]:
    s = (f"(sin(radians({lat}))*cos({m}/6371000.0)+cos(radians({lat}))*sin({m}/6371000.0)*cos(radians({brg})))")
    g = (f"{lng}+degrees(atan2(sin(radians({brg}))*sin({m}/6371000.0)*cos(radians({lat})),"
         f"cos({m}/6371000.0)-sin(radians({lat}))*{s}))")
    return f"degrees(asin({s}))", f"({g})"


def frac(lat, lng, a, b, c, d) -> str:
    """Clamped foot of a point on segment (a,b)-(c,d)."""
    k = f"(111320*greatest(0.01,cos(radians({lat}))))"
    ax, ay = f"(({b}-({lng}))*{k})", f"(({a}-({lat}))*111320)"
    dx, dy = f"(({d}-({b}))*{k})", f"(({c}-({a}))*111320)"
    sq = f"({dx}*{dx}+{dy}*{dy})"
    return f"(CASE WHEN {sq}>0 THEN greatest(0,least(1,-({ax}*{dx}+{ay}*{dy})/{sq})) ELSE 0 END)"


def segments(vertices: str = "fx_route_vertices") -> str:
    return f"""SELECT route_id, v_idx AS seg_idx, lat AS lat1, lng AS lng1, lat2, lng2, {hav('lat', 'lng', 'lat2', 'lng2')} AS seg_m,
 {bearing('lat', 'lng', 'lat2', 'lng2')} AS heading
FROM (SELECT *, lead(lat) OVER (PARTITION BY route_id ORDER BY v_idx) AS lat2,
      lead(lng) OVER (PARTITION BY route_id ORDER BY v_idx) AS lng2 FROM {vertices}) WHERE lat2 IS NOT NULL"""


def running(vertices: str = "fx_route_vertices") -> str:
    return f"""SELECT *, sum(seg_m) OVER (PARTITION BY route_id ORDER BY seg_idx) AS end_m,
 sum(seg_m) OVER (PARTITION BY route_id ORDER BY seg_idx) - seg_m AS start_m,
 sum(seg_m) OVER (PARTITION BY route_id) AS total_m FROM ({segments(vertices)})"""


def timed(vertices: str = "fx_route_vertices") -> str:
    return f"""SELECT r.*, duration_sec, start_ms, CASE WHEN total_m>0 THEN start_m/total_m*duration_sec ELSE 0 END AS t0,
 CASE WHEN total_m>0 THEN end_m/total_m*duration_sec ELSE 0 END AS t1
FROM ({running(vertices)}) r JOIN fx_routes USING (route_id)"""


def sun(rel: str, lat: str, lng: str, ms: str) -> str:
    r = "radians"
    return f"""SELECT * EXCLUDE (d_,m_,l_,dec_,ha_), fmod(degrees(atan2(sin(ha_),cos(ha_)*sin({r}({lat}))-tan(dec_)*cos({r}({lat}))))+180,360) AS sun_azimuth,
 degrees(asin(sin({r}({lat}))*sin(dec_)+cos({r}({lat}))*cos(dec_)*cos(ha_))) AS sun_altitude
FROM (SELECT *, {r}(280.16::DOUBLE+360.9856235::DOUBLE*d_)+{r}({lng})-atan2(sin(l_)*cos({r}(23.4397)),cos(l_)) AS ha_
FROM (SELECT *, asin(sin({r}(23.4397))*sin(l_)) AS dec_
FROM (SELECT *, m_+{r}(1.9148*sin(m_)+0.02*sin(2*m_)+0.0003*sin(3*m_))+{r}(102.9372)+pi() AS l_
FROM (SELECT *, {r}(357.5291::DOUBLE+0.98560028::DOUBLE*d_) AS m_
FROM (SELECT *, {ms}/86400000.0::DOUBLE-0.5+2440588-2451545 AS d_ FROM ({rel}))))))"""


def doy(ms: str) -> str:
    return f"dayofyear(DATE '1970-01-01'+CAST(floor({ms}/86400000.0::DOUBLE) AS INTEGER))"


def bird(rel: str, zenith: str, ms: str, pressure: str = "(100*pow((44331.514::DOUBLE)/11880.516,1/0.1902632::DOUBLE))") -> str:
    tau = "(0.27583*0.10+0.35*0.08)"
    return f"""SELECT * EXCLUDE (z_,am_,amp_,etr_,cz_,xo_,xw_,tr_,to_,tg_,tw_,ta_,taa_,sc_), greatest(0,ghi_-direct_horizontal) AS dhi, ghi_ AS ghi
FROM (SELECT *, coalesce(greatest(0,(direct_horizontal+etr_*cz_*0.79*to_*tg_*tw_*taa_*(0.5*(1-tr_)+0.85*sc_)/(1-am_+pow(am_,1.02)))/(1-0.2*(0.0685+0.15*sc_))),0) AS ghi_
FROM (SELECT *, dni*coalesce(cz_,0) AS direct_horizontal FROM (SELECT *, coalesce(greatest(0,0.9662*etr_*ta_*tw_*tg_*to_*tr_),0) AS dni
FROM (SELECT *, 1-ta_/taa_ AS sc_ FROM (SELECT *, 1-0.1*(1-am_+pow(am_,1.06))*(1-ta_) AS taa_
FROM (SELECT *, exp(-0.0903*pow(amp_,0.84)*(1+amp_-pow(amp_,1.01))) AS tr_,
 1-0.1611*xo_*pow(1+139.48*xo_,-0.3034)-0.002715*xo_/(1+0.044*xo_+0.0003*xo_*xo_) AS to_, exp(-0.0127*pow(amp_,0.26)) AS tg_,
 1-2.4959*xw_/(pow(1+79.034*xw_,0.6828)+6.385*xw_) AS tw_,
 exp(-pow({tau}::DOUBLE,0.873)*(1+{tau}-pow({tau}::DOUBLE,0.7088))*pow(am_,0.9108)) AS ta_
FROM (SELECT *, am_*{pressure}/101325 AS amp_, 0.30*am_ AS xo_, 1.5*am_ AS xw_,
 1364*(1+0.033*cos(2*pi()*{doy(ms)}/365.0::DOUBLE)) AS etr_, greatest(0,cos(radians(z_))) AS cz_
FROM (SELECT *, CASE WHEN z_<90 AND z_>=0 THEN 1/(cos(radians(z_))+0.15*pow(93.885::DOUBLE-z_,-1.253)) END AS am_
FROM (SELECT *, {zenith} AS z_ FROM ({rel}))))))))))"""


def exposed(vertices: str = "fx_route_vertices") -> str:
    """Segments of half a metre and more with sun, irradiance and energies."""
    base = f"SELECT *, greatest(0,t1-t0) AS segment_s, start_ms+least((t0+t1)/2,duration_sec)*1000 AS pass_ms FROM ({timed(vertices)}) WHERE seg_m>=0.5"
    lit = bird(sun(base, "lat1", "lng1", "pass_ms"), "90-sun_altitude", "pass_ms")
    theta = f"degrees(acos(greatest(-1,least(1,cos(radians(sun_altitude))*cos(radians({angle('heading', 'sun_azimuth')}))))))"
    side = f"abs(sin(radians({angle('heading', 'sun_azimuth')})))"
    return f"""SELECT *, CASE WHEN dni<=0 OR theta>=100 OR sun_altitude<=0 THEN 0 ELSE
 1-exp(-(10*(dni*93*greatest(0,cos(radians(theta))))/pow(greatest(1,theta),2))/1000) END AS glare,
 least(1.5,greatest(0,direct_horizontal/1000)) AS direct_exposure, direct_horizontal*segment_s/3600 AS direct_wh,
 dhi*segment_s/3600 AS diffuse_wh, direct_horizontal>0 AS sunlit,
 CASE WHEN direct_horizontal<=0 THEN 'night' ELSE 'estimated-shade' END AS shade_state
FROM (SELECT *, {theta} AS theta, CASE WHEN sun_altitude<=-6 THEN 1.0 WHEN sun_altitude<=-0.833 THEN 0.85
 WHEN sun_altitude<25 THEN 0.35+{side}*0.5 WHEN sun_altitude<55 THEN 0.22+{side}*0.42 ELSE 0.18+{side}*0.38 END AS shade_potential
FROM ({lit}))"""
