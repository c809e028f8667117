"""Cases of the third review: rows on which operators and their SQL gave different results, and steps that grew too fast."""

import random
import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from heliopath.functions import geo, solar
from heliopath.llm import context_trees, tables, token_files
from heliopath.llm.queries import vocabulary
from heliopath.operators import roads, spatial


def test_day_times_on_the_edge_of_a_minute(spark):
    # Sunrise and sunset as F31's SQL has them; terms added in another order moved each row by a minute.
    rows = [(37.1868, -107.4911, 801525600000, 801489300000, 801541260000), (36.172, -81.84389999999999, 734878800000, 734871300000, 734918520000),
            (39.112, -111.181, 882475200000, 882456000000, 882489900000), (39.1609, -81.12960000000001, 699141600000, 699105780000, 699146040000),
            (39.6856, -96.92060000000001, 867279600000, 867236580000, 867290460000)]
    df = spark.createDataFrame(rows, "lat double, lng double, ms long, rise long, set long").withColumn("day", solar.utc_date("ms"))
    out = solar.with_day_times(df, "day", "lat", "lng")
    assert out.filter((F.col("sunrise_ms") == F.col("rise")) & (F.col("sunset_ms") == F.col("set"))).count() == len(rows)


def test_nearest_segment_shuffles_points_and_segments_once(spark):
    rng = random.Random(5)
    line = [(r, i, 40.9 + r * 0.05 + i * 0.002, -100 + i * 0.001 * (r - 3)) for r in range(7) for i in range(40)]
    segments = spark.createDataFrame([(r, i, a, b, c, d) for (r, i, a, b), (q, _, c, d) in zip(line, line[1:]) if r == q],
                                     "route_id long, seg_idx long, lat1 double, lng1 double, lat2 double, lng2 double")
    spots = [(k, k % 7, 41 + rng.uniform(-0.3, 0.6), -100 + rng.uniform(-0.3, 0.3)) for k in range(150)] + [(150, 3, -20.0, 60.0), (151, 99, 41.0, -100.0)]
    points = spark.createDataFrame(spots, "point_id long, route_id long, lat double, lng double")
    got = {r.point_id: (r.seg_idx, r.distance) for r in spatial.nearest_segment(points, segments, first_m=400.0).collect()}
    t = geo.segment_fraction("lat", "lng", "lat1", "lng1", "lat2", "lng2", geo.lng_scale("lat"))
    gap = geo.haversine_m("lat", "lng", geo.along("lat1", "lat2", t), geo.along("lng1", "lng2", t))
    want = points.join(segments, "route_id").groupBy("point_id").agg(F.min(F.struct(F.round(gap, 6).alias("d"), "seg_idx")).alias("b"))
    want = {r.point_id: (r.b.seg_idx, r.b.d) for r in want.collect()}
    assert got.keys() == want.keys() and len(got) == 151
    assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-5 for k in want)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = spatial.nearest_segment(points, segments, only_within=75.0)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange ") == 2


def test_distinct_keys_hold_one_copy_beside_the_result():
    rng = np.random.RandomState(1)
    keys = [rng.randint(1 << 20, size=400_000).astype(np.uint64) for _ in range(5)]
    want, size = np.unique(np.concatenate(keys)), sum(k.nbytes for k in keys)
    tracemalloc.start()
    got = context_trees.distinct_keys(keys)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (got == want).all() and not keys and peak < 2 * size
    assert len(context_trees.distinct_keys([])) == 0


def test_a_small_store_gives_the_same_ids_and_stays_small():
    import pyarrow as pa

    path = vocabulary("byte_bpe_50k.json")
    small, whole = token_files.ChunkEncoder(path, 2, 50), token_files.ChunkEncoder(path, 2)
    for k in range(8):
        texts = pa.array([f"alpha beta w{k}x{i} y{i}" for i in range(60)])
        assert (small.of(texts)[0] == whole.of(texts)[0]).all()
    assert len(small.index) < len(whole.index) / 2


def test_letting_go_keeps_what_is_named():
    one, other = tables.per_worker(lambda: object()), tables.per_worker(lambda: object())
    first, second = one(), other()
    tables.let_go(one)
    assert one() is first and other() is not second


def test_expanded_fixes_and_roads_are_not_broadcast(spark):
    fixes = spark.range(3).selectExpr("id AS fix_id", "42.0 + id AS lat", "-71.0 AS lng", "cast(null AS double) AS heading", "'' AS road_name")
    line = F.array(*[F.struct((F.col("lat") + k / 1000).alias("lat"), F.col("lng")) for k in (0, 1)])
    ways = fixes.select(F.col("fix_id").alias("way_id"), line.alias("line"), F.lit("x").alias("name"))
    plan = roads.best_road(fixes, ways)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [band" in plan and "BroadcastExchange" not in plan
