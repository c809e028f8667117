"""Views deal their tables out once, and what is sampled or met needs no wide shuffles."""

import datetime
import re

from heliopath.operators import paths, similarity
from heliopath.plans.views import VIEWS, view
from heliopath.streaming import navigation


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def lines(spark, folder):
    day = datetime.date(2024, 1, 1)
    rows = [(k, n, 7 * k + n, n, 10.0 * n, day) for k in range(1, 30) for n in range(1, 6)]
    rows += [(3, 2, 23, 2, 20.0, day), (None, 1, 5, 1, 1.0, day), (None, 2, 6, None, 1.0, None)]
    df = spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double, l_shipdate date")
    df.write.parquet(f"{folder}/lineitem.parquet")
    return df


def test_a_view_deals_its_table_once_with_the_same_rows(spark, tmp_path):
    df = lines(spark, str(tmp_path))
    for name in ("fx_route_vertices", "fx_steps", "fx_osm_way_refs"):
        got = view(spark, str(tmp_path), name)
        assert len(re.findall(r"Exchange hashpartitioning", plan_of(got))) == 1
        assert sorted(map(repr, got.collect())) == sorted(map(repr, spark.sql(VIEWS[name], lineitem=df).collect()))


def test_the_last_segment_rides_along_and_samples_need_no_join_for_it(spark, tmp_path):
    lines(spark, str(tmp_path))
    segments = paths.route_segments(view(spark, str(tmp_path), "fx_route_vertices"))
    run, plain = paths.with_running_m(segments, last=True), paths.with_running_m(segments)
    joined = {(r.route_id, r.seg_idx, r.last_seg) for r in paths.with_last_segment(plain).collect()}
    assert {(r.route_id, r.seg_idx, r.last_seg) for r in run.collect()} == joined
    for n in (3, 24):
        samples = similarity.sample_routes(run, n)
        assert "last_seg" in similarity.RUNNING and plan_of(samples).count("Join") <= 2  # both of them within interpolate_at
        assert sorted(map(repr, samples.collect())) == sorted(map(repr, similarity.sample_routes(plain, n).collect()))


def test_fixes_are_listed_once_to_find_their_maneuver(spark):
    maneuvers = [(1, i, 10.0 + 0.012 * i, 20.0 + (0.011 * i) % 0.5, "turn", "left") for i in range(60)]
    fixes = [(i, 1, m[2] - 0.0101, m[3] + 0.0007, 45.0, i - 1 if i % 3 else None) for i, m in enumerate(maneuvers)]
    m = spark.createDataFrame(maneuvers, "route_id long, v_idx long, lat double, lng double, type string, modifier string")
    f = spark.createDataFrame(fixes, "fix_id long, route_id long, lat double, lng double, heading double, seg_idx long")
    out = navigation.next_maneuver(f, m)
    assert plan_of(out).count("Generate explode") == 3  # all three of the maneuvers; a fix is not multiplied
    from heliopath.functions.geo import angle_between, bearing_deg, haversine_m
    from pyspark.sql import functions as F

    every = f.alias("f").crossJoin(m.select(F.col("v_idx").alias("m_idx"), F.col("lat").alias("m_lat"), F.col("lng").alias("m_lng")))
    every = every.withColumn("maneuver_m", haversine_m("lat", "lng", "m_lat", "m_lng")).withColumn(
        "side", angle_between(bearing_deg("lat", "lng", "m_lat", "m_lng"), "heading"))
    every = every.filter((F.col("m_idx") >= F.coalesce("seg_idx", F.lit(-1)) - 2) & (F.col("maneuver_m") < 2000)
                         & ((F.col("side") < 120) | (F.col("maneuver_m") < 60)))
    want = {r.fix_id: r.m for r in every.groupBy("fix_id").agg(F.min("m_idx").alias("m")).collect()}
    assert len(want) > 40 and {r.fix_id: r.m_idx for r in out.collect()} == want
