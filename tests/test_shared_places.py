"""Points, lines and footprints that many rows share are looked at once, with the results of looking at each."""

import random

from pyspark.sql import functions as F

from heliopath.operators import occlusion, spatial


def test_shared_tunnels_and_ends_are_tested_once(spark, monkeypatch):
    rng = random.Random(3)
    spots = [(rng.uniform(0, 300), rng.uniform(0, 300)) for _ in range(20)] + [(None, 1.0)]
    lines = [(rng.uniform(0, 300), rng.uniform(0, 300), rng.uniform(0, 300), rng.uniform(0, 300)) for _ in range(6)] + [(40.0, 40.0, 40.0, 40.0)]
    points = spark.createDataFrame([(i, *spots[i % 21]) for i in range(210)], "point_id long, x double, y double").withColumns(
        {"x2": F.col("x") + 40, "y2": F.col("y") + 25})
    tunnels = spark.createDataFrame([lines[i % 7] for i in range(210)], "ax double, ay double, bx double, by_ double")
    listed, plain = [], occlusion.explode_ray
    monkeypatch.setattr(occlusion, "explode_ray", lambda df, *a, **k: (listed.append(df.count()), plain(df, *a, **k))[1])

    def gap(x, y, ax, ay, bx, by):
        n = (bx - ax) ** 2 + (by - ay) ** 2
        k = max(0, min(1, ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / n)) if n else 0
        return ((x - ax - k * (bx - ax)) ** 2 + (y - ay - k * (by - ay)) ** 2) ** 0.5

    near = {k for k, (x, y) in enumerate(spots[:20]) if min(gap(x + i, y + j, *s) for s in lines for i, j in ((0, 0), (40, 25))) < 14}
    got = [r.point_id for r in occlusion.near_tunnel(points, tunnels).collect()]
    assert sorted(got) == [i for i in range(210) if i % 21 in near] and 0 < len(near) < 20
    assert listed == [7]


def test_shared_places_are_looked_up_once(spark, monkeypatch):
    points = spark.range(300).selectExpr("id building_id", "double(id % 10 * 37) x", "double(id % 5 * 90) y")
    samples = spark.range(400).selectExpr("id sample_id", "double(id % 20 * 25) x", "double(floor(id / 20) * 25) y", "double(id * 7 % 100) elevation")
    rows = lambda df: sorted(tuple(r) for r in df.select("building_id", "sample_id", "elevation", "distance").collect())
    want = rows(spatial.nearest_within(points, samples, 12.0, "building_id", keep=["elevation"]))
    looked, plain = [], spatial._best_within
    monkeypatch.setattr(spatial, "_best_within", lambda p, *a: (looked.append(p.count()), plain(p, *a))[1])
    assert rows(spatial.nearest_of_places(points, samples, 12.0, "building_id", keep=["elevation"])) == want != []
    assert looked == [10]


def test_verdicts_test_copies_of_a_building_once(spark, monkeypatch):
    points = spark.createDataFrame([(1, 0.0, 0.0, 45.0, 5.0), (2, 0.0, 90.0, 90.0, 5.0)], "point_id long, x double, y double, sun_azimuth double, sun_altitude double")
    roofs = spark.range(60).selectExpr("id building_id", "double(id % 6 * 60) cx", "double(id % 6 * 60 + id % 2) cy", "10d half_m", "10d ground", "2d ground_error_m",
                                       "40d height_lower", "40d height_upper", "0d min_height_lower", "0d min_height_upper")
    roofs = occlusion.with_bounds(roofs.withColumn("polygon", occlusion.square("cx", "cy", "half_m")))
    samples = spark.createDataFrame([(1, 0.0, 0.0, 10.0)], "sample_id long, x double, y double, elevation double")
    rows = lambda b: sorted(tuple(r) for r in occlusion.planar_occlusion(points, b, samples).collect())
    want = rows(roofs.filter("building_id < 6"))
    tested, plain = [], occlusion.ray_hits
    monkeypatch.setattr(occlusion, "ray_hits", lambda p, b, **k: (tested.append(b.count()), plain(p, b, **k))[1])
    assert rows(roofs) == want and any(r[2] for r in want)
    assert tested == [6]
