"""Published values and single-operator cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from heliopath.functions import geo, osm, places, solar
from heliopath.functions.ephemeris import with_spa_day_times, with_spa_sun
from heliopath.operators import analysis, occlusion, packs, paths, resample, roads, roles, similarity, spatial
from heliopath.streaming import steps

SPA_MS = 1066419030000  # 2003-10-17T19:30:30Z


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_spa_published_case(spark):
    df = spark.createDataFrame([(SPA_MS, 39.742476, -105.1786, 1830.14, 82000.0, 11.0, 67.0)],
                               "ms long, lat double, lng double, h double, p double, t double, dt double")
    r = one(with_spa_sun(df, "lat", "lng", "ms", "h", "p", "t", "dt"))
    assert r["zenith"] == pytest.approx(50.111622, abs=1e-5)
    assert r["sun_azimuth"] == pytest.approx(194.340241, abs=1e-5)
    assert r["earth_radius_au"] == pytest.approx(0.9965422974, abs=1e-5)


def test_spa_sunrise_and_transit(spark):
    df = spark.createDataFrame([("2003-10-17", 39.742476, -105.1786)], "d string, lat double, lng double").withColumn(
        "day", F.col("d").cast("date"))
    r = one(with_spa_day_times(df, "day", "lat", "lng"))
    # 06:12:43, 11:46:04 and 17:18:51 local time, seven hours behind UTC.
    assert r["sunrise_hour"] == pytest.approx(13 + 12 / 60 + 43 / 3600, abs=0.01)
    assert r["transit_hour"] == pytest.approx(18 + 46 / 60 + 4 / 3600, abs=0.01)
    assert r["sunset_hour"] == pytest.approx(0 + 18 / 60 + 51 / 3600, abs=0.03)


def test_clear_sky_published_case(spark):
    # The published case gives the extraterrestrial irradiance 1414.91335; the
    # model is linear in it, so the day's own value is divided out.
    df = spark.createDataFrame([(63.52421726, 1420138800000, 0.15, 0.1)], "z double, ms long, a380 double, a500 double")
    sky = solar.with_clear_sky(df, "z", "ms", F.lit(84000.0), {"aod380": "a380", "aod500": "a500"})
    k = 1414.91335 / one(df.select(solar.extraterrestrial_w_m2("ms").alias("e")))["e"]
    sky = one(sky)
    assert sky["dni"] * k == pytest.approx(805.171223, abs=0.01)
    assert sky["direct_horizontal"] * k == pytest.approx(358.961716, abs=0.01)
    assert sky["ghi"] * k == pytest.approx(450.215507, abs=0.01)
    assert sky["dhi"] * k == pytest.approx(91.253791, abs=0.01)


def test_blocked_or_night_gives_no_glare(spark):
    df = spark.createDataFrame([(5.0, 850.0, 8.0, None), (5.0, 850.0, 8.0, 1.0), (60.0, 850.0, 8.0, None), (5.0, 850.0, -1.0, None)],
                               "theta double, dni double, alt double, occ double")
    g = [r[0] for r in df.select(solar.glare_potential("theta", "dni", "alt", "occ")).collect()]
    assert g[0] > g[2] > 0 and g[1] == 0 and g[3] == 0


@pytest.mark.parametrize("text,meters", [("12 m", 12.0), ("30 ft", 9.144), ("5'6\"", 1.676), ("2,5", 2.5), ("x", None)])
def test_lengths(spark, text, meters):
    r = one(spark.createDataFrame([(text,)], "t string").select(osm.length_m("t").alias("m")))
    assert r["m"] == meters


def test_heights_clamp_the_opening(spark):
    rows = [("12 m", None, None, None), (None, "2", None, "3"), ("4", None, "12", None), (None, None, None, None)]
    df = spark.createDataFrame(rows, "h string, l string, mh string, ml string")
    out = osm.with_height_model(df, "h", "l", "mh", "ml").collect()
    assert (out[0]["height"], out[0]["height_source"]) == (12.0, "osm-height")
    assert out[1]["height"] == pytest.approx(16.0) and out[1]["min_height"] == pytest.approx(9.6)
    assert out[2]["min_height"] == 4.0 and out[2]["min_height_source"].endswith("clamped-to-height")
    assert (out[3]["height_lower"], out[3]["height_upper"]) == (3.0, 12.0)


def test_max_speed(spark):
    df = spark.createDataFrame([("30 mph", "US"), ("50", "GB"), ("signals", "US"), ("999", "KR")], "m string, c string")
    r = [x[0] for x in df.select(osm.max_speed("m", "c")).collect()]
    assert r[0]["speed_limit_kmh"] == pytest.approx(48.28032) and r[1]["source_unit"] == "mph" and r[2] is None and r[3] is None


def test_country_outlines(spark):
    df = spark.createDataFrame([(40.7, -74.0, ""), (43.7, -79.4, ""), (37.5, 127.0, ""), (51.5, -0.1, ""), (48.9, 2.3, ""), (0.0, 0.0, "uk")],
                               "lat double, lng double, c string")
    assert [r[0] for r in df.select(places.detect_country("lat", "lng", "c")).collect()] == ["US", "INT", "KR", "GB", "INT", "GB"]


def test_step_times_follow_the_steps(spark):
    line = [(1, i, 37.0, 127.0 + i * 0.01) for i in range(3)]
    v = spark.createDataFrame(line, "route_id long, v_idx long, lat double, lng double")
    run = paths.with_running_m(paths.route_segments(v))
    steps_df = spark.createDataFrame([(1, 0, 1000.0, 20.0), (1, 1, 1000.0, 80.0)], "route_id long, step_idx long, distance double, duration double")
    d = spark.createDataFrame([(1, 100.0)], "route_id long, duration_sec double")
    t = [r["elapsed_s"] for r in paths.step_times(paths.vertices_along(run), steps_df, d).orderBy("v_idx").collect()]
    assert t == pytest.approx([0, 20, 100], abs=1e-6)


def test_blocks_do_not_change_segments(spark):
    v = spark.range(50).select(F.lit(7).cast("long").alias("route_id"), F.col("id").alias("v_idx"), (F.col("id") * 0.001 + 30).alias("lat"),
                               F.lit(10.0).alias("lng"))
    whole = paths.with_next(v, ["lat"]).orderBy("v_idx").select("v_idx", "lat", "lat_next").collect()
    small = paths.with_next(v, ["lat"], block=8).orderBy("v_idx").select("v_idx", "lat", "lat_next").collect()
    assert whole == small and len(small) == 49
    run = paths.running_totals(v.withColumn("m", F.lit(1.0)), ["m"], order="v_idx", block=8).orderBy("v_idx").collect()
    assert [r["m_run"] for r in run] == [float(i + 1) for i in range(50)] and run[0]["last_order"] == 49


def test_null_occlusion_is_exposed(spark):
    rows = [(1, 10.0, None, "uncertain"), (1, 10.0, 1.0, "confirmed-shade"), (1, 10.0, 0.0, "confirmed-clear")]
    df = spark.createDataFrame(rows, "route_id long, segment_s double, occlusion double, shade_state string").withColumns({
        "seg_m": F.lit(100.0), "total_m": F.lit(300.0), "duration_sec": F.lit(30.0), "heading": F.lit(90.0), "sun_azimuth": F.lit(90.0),
        "sun_altitude": F.lit(20.0), "dni": F.lit(800.0), "dhi": F.lit(100.0), "direct_horizontal": F.lit(300.0)})
    r = one(analysis.route_summary(analysis.with_exposure(df)))
    assert r["sunlit_s"] == 20.0 and r["confirmed_shade_ratio"] == pytest.approx(0.5)
    assert r["uncertain_time_ratio"] == pytest.approx(1 / 3)


def test_terrain_states(spark):
    df = spark.createDataFrame([(1, 140.0), (2, 124.0), (3, 100.0), (4, None)], "point_id long, elevation double").withColumns(
        {"road_z": F.lit(100.0), "sun_altitude": F.lit(10.0), "probe_m": F.lit(100.0)})
    states = {r["point_id"]: r["terrain_state"] for r in occlusion.terrain_verdict(df, 10.0).collect()}
    assert states == {1: "blocked", 2: "uncertain", 3: "clear", 4: "unknown"}


def test_shade_role_prefers_energy_inside_the_band(spark):
    rows = [(1, 10, 0, 600.0, 0.5, 500.0, 100.0, 0.1, "scene"), (1, 11, 1, 650.0, 0.5, 400.0, 90.0, 0.1, "scene"),
            (1, 12, 2, 640.0, 0.5, 420.0, 50.0, 0.1, "scene")]
    c = spark.createDataFrame(rows, "od_id long, route_id long, candidate_index long, duration_sec double, avg_glare double, "
                                    "sunlit_s double, direct_wh double, shade double, analysis_mode string")
    r = one(roles.select_roles(c))
    assert (r["fastest_route_id"], r["shade_route_id"], r["glare_route_id"]) == (10, 12, 10)
    swapped = c.withColumn("candidate_index", 2 - F.col("candidate_index"))
    assert one(roles.select_roles(swapped))["shade_route_id"] == 12


def test_greedy_duplicates_chain(spark):
    # Four parallel lines 60 m apart: 0 keeps, 1 goes, 2 stays (far from 0), 3 goes.
    rows = [(i, j, 40.0 + i * 0.00054, 10.0 + j * 0.01) for i in range(4) for j in range(3)]
    v = spark.createDataFrame(rows, "route_id long, v_idx long, lat double, lng double")
    run = paths.with_running_m(paths.route_segments(v))
    arrays = similarity.sample_arrays(similarity.sample_routes(run))
    c = run.filter("seg_idx = 0").join(arrays, "route_id").select(
        F.lit(1).alias("od_id"), F.col("route_id").alias("candidate_index"), "route_id", F.col("total_m").alias("distance_m"),
        F.lit(100.0).alias("duration_sec"), "samples")
    assert sorted(r["route_id"] for r in similarity.keep_distinct(c).collect()) == [0, 2]


def test_nearest_matches_brute_force(spark):
    s = spark.range(400).select(F.col("id").alias("sample_id"), ((F.col("id") * 37) % 1000).cast("double").alias("x"),
                                ((F.col("id") * 91) % 800).cast("double").alias("y"), (F.col("id") % 50).cast("double").alias("elevation"))
    p = spark.range(60).select(F.col("id").alias("point_id"), ((F.col("id") * 53) % 3000).cast("double").alias("x"),
                               ((F.col("id") * 29) % 700).cast("double").alias("y"))
    got = {r["point_id"]: (r["sample_id"], round(r["distance"], 6)) for r in spatial.nearest_any(p, s, first_m=20.0).collect()}
    sp, pp = s.collect(), p.collect()
    for a in pp:
        d, i = min((math.hypot(a["x"] - b["x"], a["y"] - b["y"]), b["sample_id"]) for b in sp)
        assert got[a["point_id"]] == (i, round(d, 6))


def test_floor_quantiles(spark):
    values = [float((i * 7919) % 313) for i in range(1000)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    r = one(packs.floor_quantiles(df, "v", {"a": 0.5, "b": 0.95, "c": 0.0, "d": 1.0}, buckets=16))
    s = sorted(values)
    assert [r["a"], r["b"], r["c"], r["d"]] == [s[499], s[949], s[0], s[999]]


def test_packs_hold_every_tile_within_limits(spark):
    t = spark.range(600).select((F.col("id") % 30).alias("tx"), F.floor(F.col("id") / 30).alias("ty"),
                                (F.lit(20000) + (F.col("id") * 7919) % 900000).alias("zip_bytes"))
    a = packs.assign_packs(t).cache()
    assert packs.coverage_check(t, a).isEmpty()
    assert packs.pack_table(a).filter(F.col("bytes") > packs.SOFT_MAX_BYTES).isEmpty()
    first = {r["pack"] for r in packs.pack_table(a).collect()}
    again = {r["pack"] for r in packs.pack_table(packs.assign_packs(t.orderBy(F.desc("zip_bytes")))).collect()}
    assert first == again
    huge = spark.createDataFrame([(0, 0, packs.HARD_MAX_BYTES), (1, 0, 5), (1, 0, 9), (2, 0, 7)], "tx long, ty long, zip_bytes long")
    assert [(r.tx, r.reason) for r in packs.refused_tiles(huge).collect()] == [(0, "TILE_OVER_HARD_LIMIT")]
    assert {r.tx for r in packs.coverage_check(huge, packs.assign_packs(huge)).collect()} == {0, 1}


def test_packs_follow_the_rule(spark):
    """Dense squares alone; light neighbours joined up to the target; no pack over 8 tiles wide or the soft limit."""
    rng = np.random.default_rng(8)
    t = spark.createDataFrame([(int(x), int(y), int(z)) for (x, y), z in zip(
        {(int(a), int(b)) for a, b in rng.integers(-20, 20, (700, 2))}, rng.integers(1000, 3_000_000, 700))],
        "tx long, ty long, zip_bytes long")
    a = packs.assign_packs(t).collect()
    held = {}
    for r in a:
        held.setdefault((r.seed_x, r.seed_y, r.pack_no), []).append(r)
    squares = {}
    for r in a:
        squares.setdefault((r.tx // 2, r.ty // 2), []).append(r)
    for rows in squares.values():
        assert {r.dense for r in rows} == {sum(r.zip_bytes for r in rows) + packs.END_RECORD_BYTES >= packs.DENSE_BYTES}
    for rows in held.values():
        assert len({r.dense for r in rows}) == 1
        if rows[0].dense:
            assert len({(r.tx // 2, r.ty // 2) for r in rows}) == 1
        assert len(rows) == 1 or sum(r.zip_bytes for r in rows) + packs.END_RECORD_BYTES <= packs.SOFT_MAX_BYTES
        assert max(r.tx for r in rows) - min(r.tx for r in rows) < 8 and max(r.ty for r in rows) - min(r.ty for r in rows) < 8


def test_evenly_picked_positions(spark):
    for length, wanted in ((10, 4), (7, 7), (50, 13), (5, 1)):
        df = spark.range(length).filter(resample.picked(F.col("id"), F.lit(length), F.lit(wanted)))
        want = {math.floor(i * (length - 1) / max(1, wanted - 1) + 0.5) for i in range(wanted)}
        assert {r["id"] for r in df.collect()} == want


def test_place_merge_replaces_for_addresses(spark):
    rows = [(1, "94 Gerry Road", 0, 40.0, -74.0, "94 Alton Road", ""), (1, "94 Gerry Road", 1, 40.0001, -74.0, "94 Gerry Road", "94"),
            (1, "94 Gerry Road", 2, 41.0, -74.0, "Far", ""), (2, "gerry", 3, 40.0, -74.0, "a", ""), (2, "gerry", 4, 40.0, -74.0, "gerry", "")]
    df = spark.createDataFrame(rows, "query_id long, query string, result_id long, lat double, lng double, display_name string, house_number string")
    df = df.withColumns({"order_no": F.col("result_id"), "short_title": F.lit(""), "road": F.lit(""), "importance": F.lit(0.0)})
    assert sorted(r["result_id"] for r in roads.merge_place_results(df).collect()) == [1, 2, 3]


def test_fix_rules():
    base = {"fix_ms": 0, "lat": 42.0, "lng": -71.0, "accuracy": 10.0, "source": "web-watch", "reported_speed_kmh": None, "hw_heading": None}
    state = {}
    assert steps.accept_fix(state, base)["reason"] == "FIRST_RELIABLE_FIX"
    assert steps.accept_fix(state, {**base, "fix_ms": 5000, "accuracy": 80.0})["reason"] == "LOW_ACCURACY"
    assert steps.accept_fix(state, {**base, "fix_ms": 6000, "lat": 42.1})["reason"] == "IMPLAUSIBLE_JUMP"
    assert steps.accept_fix(state, {**base, "fix_ms": 900})["reason"] == "DUPLICATE_FIX"
    assert steps.accept_fix(state, {**base, "fix_ms": 10000, "lat": 42.001})["reason"] == "RELIABLE_FIX"
    assert steps.accept_fix(state, {**base, "fix_ms": 8000})["reason"] == "LATE_FIX"


def test_route_following_is_monotonic_and_arrives():
    near = lambda seg, t, gap: {"seg": seg, "t": t, "lat": 1.0, "lng": 1.0, "gap": gap, "bearing": 90.0}
    row = {"fix_ms": 0, "accepted": True, "lat": 1.0, "lng": 1.0, "heading": 90.0, "speed_kmh": 20.0, "goal_m": 900.0, "last_seg": 9}
    state = {}
    assert steps.follow_route(state, {**row, "near": [near(3, 0.5, 5.0)]})["seg_idx"] == 3
    assert steps.follow_route(state, {**row, "near": [near(3, 0.1, 1.0), near(1, 0.0, 0.5)]})["seg_t"] == 0.5
    assert steps.follow_route(state, {**row, "near": [near(4, 0.0, 70.0)]})["event"] == "off_route"
    assert steps.follow_route(state, {**row, "near": [near(8, 0.0, 3.0)], "goal_m": 70.0})["event"] == "arrival"
    assert steps.follow_route(state, {**row, "near": []})["event"] == "arrived_before"


def test_tile_round_trip(spark):
    df = spark.createDataFrame([(42.3601, -71.0589)], "lat double, lng double")
    tx, ty = geo.tile_of("lat", "lng")
    r = one(df.withColumn("tx", tx).withColumn("ty", ty).withColumn("b", F.struct(*[
        c.alias(n) for c, n in zip(geo.tile_bounds("tx", "ty"), "swne")])))
    assert r["b"]["s"] <= 42.3601 < r["b"]["n"] and r["b"]["w"] <= -71.0589 < r["b"]["e"]


def test_nearest_at_any_distance_in_groups(spark):
    """Far clusters, negative places, ties and a group without samples."""
    rng = np.random.default_rng(3)
    rows = [(g, i, float(x), float(y)) for g in (1, 2) for i, (x, y) in enumerate(
        np.concatenate([rng.normal((-9000, 4000), 300, (60, 2)), rng.normal((50_000, -70_000), 2000, (60, 2)), [[0, 0], [0, 0]]]))]
    samples = spark.createDataFrame(rows, "g long, sample_id long, x double, y double")
    at = [(g, i, float(x), float(y)) for g in (1, 2, 3) for i, (x, y) in enumerate(rng.uniform(-100_000, 100_000, (80, 2)))]
    points = spark.createDataFrame([(1000 * g + i, g, x, y) for g, i, x, y in at], "point_id long, g long, x double, y double")
    got = {r.point_id: (r.sample_id, round(r.distance, 6)) for r in spatial.nearest_any(points, samples, by=["g"], first_m=150.0).collect()}
    want = {}
    for g, i, x, y in at:
        if g < 3:
            d, s = min((math.hypot(x - b[2], y - b[3]), b[1]) for b in rows if b[0] == g)
            want[1000 * g + i] = (s, round(d, 6))
    assert got == want


def test_nearest_marks_by_index(spark):
    from heliopath.operators import tiles

    rng = np.random.default_rng(5)
    marks = {(r, int(v)) for r in (1, 2) for v in rng.integers(0, 20_000, 40)}
    segments = [(r, int(i)) for r in (1, 2, 3) for i in rng.integers(0, 20_000, 60)] + [(1, next(iter(marks))[1])]
    got = tiles.nearest_by_index(
        spark.createDataFrame([(r, i, n) for n, (r, i) in enumerate(segments)], "route_id long, seg_idx long, n long"),
        spark.createDataFrame([(r, v, v * 10) for r, v in marks], "route_id long, v_idx long, w long"), ["w"], "near").collect()
    assert len(got) == len(segments)
    for row in got:
        own = sorted((abs(v - row.seg_idx), v) for r, v in marks if r == row.route_id)
        assert (row.near_gap, row.near_w) == ((own[0][0], own[0][1] * 10) if own else (None, None))


def test_pieces_of_a_long_route(spark):
    """A running total that begins anew at each cut, over several thousand vertices and an uneven step."""
    from heliopath.operators import tiles

    rng = np.random.default_rng(6)
    lng = np.cumsum(rng.choice([0.00001, 0.0005, 0.03], 5000, p=[0.7, 0.29, 0.01]))
    v = spark.createDataFrame([(7, i, 10.0, float(x)) for i, x in enumerate(lng)] + [(8, 0, 1.0, 1.0), (8, 1, 1.0, 1.2)],
                              "route_id long, v_idx long, lat double, lng double")
    got = {(r.route_id, r.seg_idx): r.piece for r in tiles.split_by_length(v, 5000.0).collect()}
    piece, run = 0, 0.0
    for r in sorted(paths.route_segments(v).filter("route_id = 7").collect(), key=lambda r: r.seg_idx):
        assert got[7, r.seg_idx] == piece
        run += r.seg_m
        if run >= 5000.0:
            piece, run = piece + 1, 0.0
    assert piece > 10 and got[8, 0] == 0
