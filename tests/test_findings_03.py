"""Cases of the third round's findings: steps that shuffled or repeated more than their input."""

import math
import random

from heliopath.operators import shade_chain


def test_nearest_in_planes_shuffles_points_and_samples_once(spark):
    """As brute force in the point's plane, ties by the lower id; points are not multiplied and no plane list is joined to the samples."""
    rng = random.Random(8)
    spots = [(i, 41 + rng.uniform(-0.06, 0.06), -74 + rng.uniform(-0.06, 0.06)) for i in range(300)] + [(300, 60.0, 10.0), (301, None, 10.0)]
    held = [(i, 41 + rng.uniform(-0.06, 0.06), -74 + rng.uniform(-0.06, 0.06), float(i)) for i in range(900)]
    held += [(i + 5000, a, o, -1.0) for i, a, o, _ in held[:200]]
    points = spark.createDataFrame(spots, "point_id long, lat double, lng double")
    samples = spark.createDataFrame(held, "sample_id long, lat double, lng double, elevation double")
    out = shade_chain.nearest_in_planes(points, samples, 180.0, ["elevation", "s_lat"])
    got = {r.point_id: (r.sample_id, r.elevation, r.s_lat, r.distance) for r in out.collect()}
    planes = {r.point_id: (r.ptx, r.pty) for r in shade_chain.in_own_plane(points).collect()}
    want = {}
    for i, a, o in spots[:301]:
        lat0 = 41 + math.degrees((planes[i][1] + 0.5) * 5000 / 6371000)
        lng_m = 6371000 * math.cos(math.radians(lat0))
        near = min((math.hypot(math.radians(o - d) * lng_m, math.radians(a - c) * 6371000), j, e, c) for j, c, d, e in held)
        if near[0] <= 180:
            want[i] = (near[1], near[2], near[3])
    got = {k: v[:3] for k, v in got.items()}
    bad = {k: (got.get(k), want.get(k)) for k in got.keys() | want.keys() if got.get(k) != want.get(k)}
    assert len(want) > 50 and not bad, (len(got), len(want), len(bad), list(bad.items())[:3])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = shade_chain.nearest_in_planes(points, samples, 180.0, ["elevation"])._jdf.queryExecution().executedPlan().toString()
        whole = shade_chain.anchor_profiles(points.selectExpr("point_id route_id", "0 profile_idx", "lat", "lng", "1d direction"), samples)
        chain = whole._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange ") == 2 and "LeftSemi" not in chain


def test_rays_are_listed_in_cells_once(spark):
    """Cells of a ray that pass the roofs' heights go on to the roofs; the rays are not listed a second time."""
    from pyspark.sql import functions as F

    from heliopath.operators.occlusion import square, with_bounds, with_ray

    zero = F.lit(0).cast("long")
    points = with_ray(spark.createDataFrame([(1, 0.0, 0.0, 45.0, 20.0, 10.0)], "point_id long, x double, y double, sun_azimuth double, sun_altitude double, road_z double"))
    roofs = spark.createDataFrame([(1, 50.0, 50.0, 10.0)], "building_id long, cx double, cy double, half double").select(
        "building_id", F.lit(10.0).alias("ground"), F.lit(1.0).alias("ground_error_m"), F.lit(60.0).alias("height_lower"), F.lit(70.0).alias("height_upper"),
        F.lit(0.0).alias("min_height_lower"), F.lit(0.0).alias("min_height_upper"), square("cx", "cy", "half").alias("polygon"))
    plane = {"ptx": zero, "pty": zero}
    hits = shade_chain.roof_hits(points.withColumns(plane), with_bounds(roofs).withColumns(plane))
    assert {r.building_id for r in hits.collect()} == {1}
    assert "LeftSemi" not in hits._jdf.queryExecution().optimizedPlan().toString()


def test_copies_of_candidates_are_shuffled_and_stored_once(spark, monkeypatch):
    from heliopath.operators import similarity

    rng = random.Random(2)
    line = [[(40 + k * 1e-3 + s * 1e-2, -74.0 + rng.random() * 1e-6) for k in range(8)] for s in range(4)]
    rows = [(1, c, 100 + c, 1000.0 + c % 4 * 500, 60.0, [{"lat": a, "lng": b} for a, b in line[c % 4]]) for c in range(12)]
    candidates = spark.createDataFrame(rows, "od_id long, candidate_index int, route_id long, distance_m double, duration_sec double, samples array<struct<lat double, lng double>>")
    stored, cut = [], similarity.cut_lineage
    monkeypatch.setattr(similarity, "cut_lineage", lambda df: (stored.append(df), cut(df))[1])
    kept = similarity.keep_distinct(candidates)
    assert kept.columns == candidates.columns
    assert sorted((r.candidate_index, r.route_id) for r in kept.collect()) == [(c, 100 + c) for c in range(4)]
    held = [df for df in stored if "samples" in df.columns]
    assert len(held) == 1 and "Join" not in held[0]._jdf.queryExecution().optimizedPlan().toString()


def test_segment_profiles_read_stored_anchors(spark):
    from __spark_entry__ import SMOKE_DIR, queries

    plan = queries()["J10_segment_profiles"](spark, SMOKE_DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert "sample_id" not in plan
