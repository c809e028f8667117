"""Findings of the third round's list, worked on later."""

import pyarrow as pa
from pyspark.sql import functions as F

from heliopath.functions.geo import tile_of
from __spark_entry__ import queries
from heliopath.llm import spaced_seeds
from heliopath.operators import paths, resample, shade_chain
from heliopath.sources import files


def test_samples_of_several_regions_travel_once(spark):
    """F8, F9, F10: parts know the tiles of each region, samples need no copy for each."""
    points = spark.createDataFrame([(1, "a", 41.0001, -73.9999), (2, "b", 41.0001, -73.9999), (3, "c", 41.0001, -73.9999)],
                                   "point_id int, region string, lat double, lng double")
    # Three places in as many tiles around the grid's origin; the second is the nearest.
    samples = spark.createDataFrame([(1, 41.0009, -73.9992, 5.0), (2, 40.9999, -73.9999, 7.0), (3, 41.0002, -74.0009, 9.0)],
                                    "sample_id int, lat double, lng double, elevation double")
    tx, ty = tile_of("lat", "lng")
    tiles = {r.sample_id: (r.tx, r.ty) for r in samples.select("sample_id", tx.alias("tx"), ty.alias("ty")).collect()}
    assert len(set(tiles.values())) == 3
    loaded = spark.createDataFrame([("a", *tiles[1]), ("b", *tiles[1]), ("b", *tiles[2]), ("c", *tiles[3])], "region string, tx long, ty long")
    near = shade_chain.nearest_in_planes(points, samples, 180.0, ["elevation"], loaded=loaded)
    assert {r.point_id: r.sample_id for r in near.collect()} == {1: 1, 2: 2, 3: 3}
    # The plan's only read of the samples goes straight to the parts, without a join or an aggregate before.
    plan = near._jdf.queryExecution().optimizedPlan().toString()
    below = plan[:plan.rindex("elevation#")].splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    path = []
    for line in reversed([*below, plan[plan.rindex("elevation#"):].splitlines()[0]][:-1]):
        if not path or depth(line) < depth(path[-1]):
            path.append(line)
    to_parts = path[:[i for i, line in enumerate(path) if "RepartitionByExpression" in line][0]]
    assert not any("Join" in line or "Aggregate" in line for line in to_parts)


def test_responses_are_parsed_once(spark):
    """F25, F31 to F33, F37: a text is parsed once, and without routes it gives no row."""
    step = '{"distance":%d,"duration":1,"maneuver":{"type":"%s","location":[1,2]}}'
    text = '{"routes":[{"geometry":{"coordinates":[[1,2]]},"legs":[{"steps":[' + ",".join([step % (5, "depart"), step % (7, "turn"), step % (9, "turn")]) + "]}]}]}"
    landed = spark.createDataFrame([(1, text), (2, '{"routes":[]}'), (3, "{}"), (4, "no json"), (5, None)], "od_id int, response string")
    routes = files.route_candidates(landed.repartition(2)).withColumnRenamed("od_id", "route_id")
    assert [r.route_id for r in routes.collect()] == [1]
    out = files.maneuvers(files.route_steps(routes, ["route_id"]))
    assert [(r.step_idx, r.cumulative_m, r.lat) for r in out.orderBy("step_idx").collect()] == [(1, 5.0, 2.0), (2, 12.0, 2.0)]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1


def test_running_segments_are_worked_out_once(spark):
    """distances to test are made from stored segments, without their windows in each branch."""
    vertices = spark.range(1, 4).selectExpr("id route_id", "explode(sequence(0L, 9L)) v_idx").selectExpr(
        "route_id", "v_idx", "41 + 0.001 * v_idx lat", "-74 + 0.001 * (v_idx % 3) * route_id lng")
    running = paths.with_running_m(paths.route_segments(vertices))
    made = resample.resample(running)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "seg_m" in plan and "haversine" not in plan.lower() and "lead(" not in plan and "ATAN2" not in plan.upper()
    whole = running.groupBy("route_id").agg(F.max("total_m").alias("m"))
    ends = made.groupBy("route_id").agg(F.min("target_m").alias("a"), F.max("target_m").alias("z")).join(whole, "route_id").collect()
    assert len(ends) == 3 and all(r.a == 0 and r.z == r.m for r in ends)


def test_decontamination_holds_little_and_lets_go(spark, monkeypatch):
    """pipeline: a batch of long texts is worked on in parts, and the worker keeps nothing for the stages in the JVM alone."""
    made, sizes, freed = [], [], []

    class Docs:
        sparkSession, columns, schema = spark, ["doc_id", "text"], "doc_id long, text string"

        def mapInArrow(self, work, schema):
            made.append(work)
            return self

    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    spaced_seeds.without_leaks(Docs(), spark.createDataFrame([(1, item)], "item_id int, text string"))
    texts_of = spaced_seeds.texts_of
    monkeypatch.setattr(spaced_seeds, "texts_of", lambda column: sizes.append(column.nbytes) or texts_of(column))
    monkeypatch.setattr(spaced_seeds, "let_go", lambda *but: freed.append(but), raising=False)
    long = "word " * 600_000
    batch = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array([long] * 6 + [item, None])], ["doc_id", "text"])
    kept = [i for out in made[0](iter([batch])) for i in out.column(0).to_pylist()]
    assert kept == [0, 1, 2, 3, 4, 5, 7]
    assert len(sizes) >= 3 and freed == [()]


def test_required_tiles_are_worked_out_once(spark):
    """tiles asked for, present and failed are all read from one stored list."""
    plan = queries()["J2_X3_tile_status"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "parquet" not in plan.lower()
