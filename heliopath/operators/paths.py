"""Route polylines: segments, running distances, elapsed time, interpolation.

A polyline is rows ``(route_id, v_idx, lat, lng)`` with a dense ``v_idx`` from 0.
One route may hold a large part of all rows, so nothing here puts a whole route
into one task: windows run over (route, block of indexes), the first vertex of
a block is also given to the block before it, and block totals are combined in a
second, much smaller step. Lookups by distance are equi-joins on (route, bucket).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import along, angle_between, bearing_deg, clamp, distance_m, haversine_m

BLOCK = 4096
BUCKET_M = 2000.0
MIN_SEGMENT_M = 0.5
TURN_DEG = 18.0


def with_next(rows: DataFrame, columns: list[str], key: str = "route_id", order: str = "v_idx",
              block: int = BLOCK) -> DataFrame:
    """Pair each row with its successor in dense ``order``; adds ``<col>_next``.

    The last row of a key has no successor and is dropped. ``block_no`` stays in
    the result so that later block-wise steps reuse the same partitioning.
    """
    own = F.floor(F.col(order) / block)
    blocks = F.when((F.col(order) % block == 0) & (F.col(order) > 0), F.array(own, own - 1)).otherwise(F.array(own))
    w = Window.partitionBy(key, "block_no").orderBy(order)
    paired = rows.withColumn("block_no", F.explode(blocks))
    for name in columns:
        paired = paired.withColumn(f"{name}_next", F.lead(name).over(w))
    return (paired.withColumn("_more", F.lead(F.lit(True)).over(w))
            .filter(F.col("_more") & (own == F.col("block_no"))).drop("_more"))


def route_segments(vertices: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """Vertex pairs: seg_idx, (lat1, lng1), (lat2, lng2) and seg_m."""
    names = ["lat", "lng", *(carry or [])]
    pairs = with_next(vertices.select("route_id", "v_idx", *names), names)
    extra = [c for n in (carry or []) for c in (n, f"{n}_next")]
    return pairs.select(
        "route_id", F.col("v_idx").alias("seg_idx"), "block_no",
        F.col("lat").alias("lat1"), F.col("lng").alias("lng1"),
        F.col("lat_next").alias("lat2"), F.col("lng_next").alias("lng2"),
        distance_m("lat", "lng", "lat_next", "lng_next").alias("seg_m"), *extra)


def with_heading(segments: DataFrame) -> DataFrame:
    return segments.withColumn("heading", bearing_deg("lat1", "lng1", "lat2", "lng2"))


def with_running_m(segments: DataFrame, attributes: DataFrame | None = None, last: bool = False) -> DataFrame:
    """Add start_m, end_m and total_m; per-route ``attributes`` ride along, and with ``last`` last_seg.

    Attributes join the per-block totals, so the segments are not shuffled again.
    """
    keys = ["route_id", "block_no"]
    w = Window.partitionBy("route_id").orderBy("block_no")
    ends = [F.max("seg_idx").alias("_max")] if last else []
    totals = segments.groupBy(*keys).agg(F.sum("seg_m").alias("_sum"), *ends)
    totals = totals.select(
        *keys, *[F.max("_max").over(Window.partitionBy("route_id")).alias("last_seg") for _ in ends],
        F.coalesce(F.sum("_sum").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("_before"),
        F.sum("_sum").over(Window.partitionBy("route_id")).alias("total_m"))
    if attributes is not None:
        totals = totals.join(attributes, "route_id")
    local = Window.partitionBy(*keys).orderBy("seg_idx")
    sums = segments.withColumn("_to", F.sum("seg_m").over(local.rowsBetween(Window.unboundedPreceding, 0)))
    sums = sums.withColumn("_from", F.coalesce(
        F.sum("seg_m").over(local.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    out = sums.join(totals, keys)
    out = out.withColumn("start_m", F.col("_before") + F.col("_from"))
    return out.withColumn("end_m", F.col("_before") + F.col("_to")).drop("_before", "_from", "_to")


def running_totals(rows: DataFrame, values: list[str], key: str = "route_id", order: str = "step_idx",
                   block: int = BLOCK) -> DataFrame:
    """Add ``<v>_run`` and ``<v>_total`` per key, and ``last_order``, block by block."""
    keys = [key, "_block"]
    blocked = rows.withColumn("_block", F.floor(F.col(order) / block))
    w = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(key)
    totals = blocked.groupBy(*keys).agg(F.max(order).alias("_max"), *[F.sum(v).alias(f"_sum_{v}") for v in values])
    totals = totals.select(
        *keys, F.max("_max").over(whole).alias("last_order"),
        *[F.coalesce(F.sum(f"_sum_{v}").over(w), F.lit(0.0)).alias(f"_before_{v}") for v in values],
        *[F.sum(f"_sum_{v}").over(whole).alias(f"{v}_total") for v in values])
    local = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    for v in values:
        blocked = blocked.withColumn(f"_in_{v}", F.sum(v).over(local))
    out = blocked.join(totals, keys)
    for v in values:
        out = out.withColumn(f"{v}_run", F.col(f"_before_{v}") + F.col(f"_in_{v}"))
    return out.drop("_block", *[f"_before_{v}" for v in values], *[f"_in_{v}" for v in values])


def with_uniform_times(running: DataFrame, duration: str = "duration_sec") -> DataFrame:
    """Elapsed seconds at both segment ends, in proportion to distance."""
    d = F.greatest(F.lit(0.0), F.coalesce(F.col(duration), F.lit(0.0)))
    at = lambda m: F.when(F.col("total_m") > 0, F.col(m) / F.col("total_m") * d).otherwise(F.lit(0.0))
    return running.withColumn("t0", at("start_m")).withColumn("t1", at("end_m"))


def vertices_along(running: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Vertices with their distance from the start, out of running segments."""
    keep = keep or []
    first = F.struct(F.col("seg_idx").alias("v_idx"), F.col("lat1").alias("lat"),
                     F.col("lng1").alias("lng"), F.col("start_m").alias("along_m"), F.lit(False).alias("is_last"))
    last = F.struct((F.col("seg_idx") + 1).alias("v_idx"), F.col("lat2").alias("lat"),
                    F.col("lng2").alias("lng"), F.col("end_m").alias("along_m"), F.lit(True).alias("is_last"))
    tail = F.col("seg_idx") == F.col("last_seg")
    counted = running if "last_seg" in running.columns else with_last_segment(running)
    return counted.select("route_id", "total_m", *keep,
                          F.explode(F.when(tail, F.array(first, last)).otherwise(F.array(first))).alias("_v")
                          ).select("route_id", "total_m", *keep, "_v.*")


def with_last_segment(segments: DataFrame) -> DataFrame:
    last = segments.groupBy("route_id").agg(F.max("seg_idx").alias("last_seg"))
    return segments.join(last, "route_id")


def usable_steps(steps: DataFrame) -> DataFrame:
    """Steps with a length, with running distance and time and their totals."""
    good = steps.filter(F.coalesce(F.col("distance"), F.lit(0.0)) > 0).withColumn(
        "duration", F.greatest(F.lit(0.0), F.coalesce(F.col("duration"), F.lit(0.0))))
    run = running_totals(good.select("route_id", "step_idx", "distance", "duration"), ["distance", "duration"])
    return run.select(
        "route_id", "step_idx", "distance", "duration", F.col("distance_run").alias("hi_m"),
        F.col("duration_run").alias("hi_s"), F.col("distance_total").alias("steps_m"),
        F.col("duration_total").alias("steps_s"),
        (F.col("distance_run") <= F.col("distance")).alias("is_first"),
        (F.col("step_idx") == F.col("last_order")).alias("is_last_step"))


def step_times(vertices: DataFrame, steps: DataFrame, durations: DataFrame, bucket_m: float = BUCKET_M) -> DataFrame:
    """Elapsed seconds per vertex from step durations scaled to the route.

    ``vertices`` needs along_m, total_m and is_last; ``durations`` is
    ``(route_id, duration_sec)``. Routes without usable steps fall back to
    distance. The interval is the first whose end is not before the vertex.
    """
    ready = usable_steps(steps).withColumn("lo_m", F.col("hi_m") - F.col("distance")).withColumn(
        "lo_s", F.col("hi_s") - F.col("duration"))
    top = F.floor(F.col("hi_m") / bucket_m) + F.when(F.col("is_last_step"), 1).otherwise(0)
    ready = ready.filter(F.col("steps_s") > 0).withColumn(
        "_b", F.explode(F.sequence(F.floor(F.col("lo_m") / bucket_m), top)))
    totals = ready.filter("is_last_step").select("route_id", "steps_m").dropDuplicates(["route_id"])
    v = vertices.join(durations, "route_id").join(totals, "route_id", "left")
    d = F.greatest(F.lit(0.0), F.coalesce(F.col("duration_sec"), F.lit(0.0)))
    v = v.withColumn("_d", d).withColumn(
        "_target", F.when((F.col("_d") > 0) & (F.col("total_m") > 0), F.col("along_m") * (F.col("steps_m") / F.col("total_m"))))
    v = v.withColumn("_b", F.least(F.floor(F.col("_target") / bucket_m), F.floor(F.col("steps_m") / bucket_m) + 1))
    s = ready.select("route_id", "_b", "lo_m", "hi_m", "lo_s", "duration", "distance", "steps_s",
                     "is_first", "is_last_step")
    inside = ((F.col("_target") > F.col("lo_m")) | F.col("is_first")) & (
        (F.col("_target") <= F.col("hi_m")) | F.col("is_last_step"))
    hit = v.alias("v").join(s.alias("s"), (F.col("v.route_id") == F.col("s.route_id"))
                            & (F.col("v._b") == F.col("s._b")) & inside, "left")
    scale = F.col("_d") / F.col("steps_s")
    stepped = clamp(F.col("lo_s") * scale + (F.col("_target") - F.col("lo_m")) / F.col("distance")
                    * F.col("s.duration") * scale, 0.0, F.col("_d"))
    uniform = F.when(F.col("total_m") > 0, F.col("along_m") / F.col("total_m") * F.col("_d")).otherwise(F.lit(0.0))
    elapsed = F.when(stepped.isNull(), uniform).when(F.col("is_last"), F.col("_d")).otherwise(stepped)
    return hit.select("v.route_id", "v_idx", "lat", "lng", "along_m", "total_m", "is_last",
                      F.col("_d").alias("duration_sec"), elapsed.alias("elapsed_s"))


def interpolate_at(targets: DataFrame, running: DataFrame, bucket_m: float = BUCKET_M) -> DataFrame:
    """Coordinates at ``target_m`` along each route.

    Targets at or before the start take the first vertex, at or past the end the
    last one; in between the first segment reaching the target is used.
    """
    span = running.withColumn("_b", F.explode(F.sequence(
        F.floor(F.col("start_m") / bucket_m), F.floor(F.col("end_m") / bucket_m)))).select(
        "route_id", "_b", "start_m", "end_m", "seg_m", "seg_idx", "total_m", "lat1", "lng1", "lat2", "lng2")
    totals = running.filter("seg_idx = 0").select("route_id", F.col("total_m").alias("_total"))
    t = targets.join(totals, "route_id").withColumn("_at", clamp("target_m", 0.0, F.col("_total")))
    t = t.withColumn("_b", F.floor(F.col("_at") / bucket_m)).drop("_total")
    reach = (F.col("_at") <= F.col("end_m")) & ((F.col("_at") > F.col("start_m")) | (F.col("seg_idx") == 0))
    hit = t.alias("t").join(span.alias("s"), (F.col("t.route_id") == F.col("s.route_id"))
                            & (F.col("t._b") == F.col("s._b")) & reach)
    fraction = F.when(F.col("seg_m") > 0, (F.col("_at") - F.col("start_m")) / F.col("seg_m")).otherwise(F.lit(0.0))
    return hit.select(*[F.col(f"t.{c}") for c in targets.columns], F.col("seg_idx").alias("at_seg"),
                      along("lat1", "lat2", fraction).alias("lat"), along("lng1", "lng2", fraction).alias("lng"))


def sharp_turns(segments: DataFrame, threshold: float = TURN_DEG) -> DataFrame:
    """Inner vertices where the heading changes by at least ``threshold``."""
    headed = with_heading(segments).withColumnRenamed("seg_idx", "v_idx").drop("block_no")
    carry = [c for c in ("heading", "end_m") if c in headed.columns]
    pairs = with_next(headed.select("route_id", "v_idx", *[c for c in headed.columns if c in
                                    ("heading", "end_m", "total_m")]), carry)
    turn = angle_between("heading", "heading_next")
    out = pairs.withColumn("turn_deg", turn).filter(F.col("turn_deg") >= threshold)
    extra = [c for c in ("end_m", "total_m") if c in out.columns]
    return out.select("route_id", (F.col("v_idx") + 1).alias("v_idx"), "turn_deg", *extra)


def remaining_m(positions: DataFrame, running: DataFrame) -> DataFrame:
    """Distance to go from a position on segment ``seg_idx``."""
    seg = running.select("route_id", "seg_idx", "lat2", "lng2", "end_m", "total_m")
    return positions.join(seg, ["route_id", "seg_idx"]).withColumn(
        "remaining_m", distance_m("lat", "lng", "lat2", "lng2") + (F.col("total_m") - F.col("end_m"))
    ).drop("lat2", "lng2", "end_m", "total_m")


def remaining_s(positions: DataFrame, timed: DataFrame, duration: str = "duration_sec") -> DataFrame:
    """Seconds to go from fraction ``t`` of segment ``seg_idx``."""
    seg = timed.select("route_id", "seg_idx", "t0", "t1", F.col(duration).alias("_d"))
    fraction = clamp(F.coalesce(F.col("t"), F.lit(0.0)), 0.0, 1.0)
    return positions.join(seg, ["route_id", "seg_idx"]).withColumn(
        "remaining_s", clamp(F.col("_d") - (F.col("t0") + (F.col("t1") - F.col("t0")) * fraction), 0.0, F.col("_d"))
    ).drop("t0", "t1", "_d")


def route_extent(vertices: DataFrame, padding_m: float = 250.0) -> DataFrame:
    """Padded bounding box with its width, height and area."""
    from ..functions.geo import DEG, EARTH_RADIUS_M, rad

    box = vertices.filter(F.col("lat").isNotNull() & F.col("lng").isNotNull()).groupBy("route_id").agg(
        F.min("lat").alias("s0"), F.max("lat").alias("n0"), F.min("lng").alias("w0"), F.max("lng").alias("e0"))
    lat_pad = padding_m / EARTH_RADIUS_M * DEG
    lng_pad = F.lit(padding_m * DEG) / (EARTH_RADIUS_M * F.cos(rad((F.col("s0") + F.col("n0")) / 2)))
    box = box.select("route_id", (F.col("s0") - lat_pad).alias("south"), (F.col("w0") - lng_pad).alias("west"),
                     (F.col("n0") + lat_pad).alias("north"), (F.col("e0") + lng_pad).alias("east"))
    mid = (F.col("south") + F.col("north")) / 2
    box = box.withColumn("width_m", haversine_m(mid, "west", mid, "east")).withColumn(
        "height_m", haversine_m("south", "west", "north", "west"))
    return box.withColumn("area_km2", F.col("width_m") * F.col("height_m") / 1e6)


def route_lengths(segments: DataFrame) -> DataFrame:
    return segments.groupBy("route_id").agg(F.sum("seg_m").alias("length_m"))


def valid_point(lat: str | Column, lng: str | Column) -> Column:
    lat, lng = (F.col(c) if isinstance(c, str) else c for c in (lat, lng))
    ok = lat.between(-90, 90) & lng.between(-180, 180) & ~F.isnan(lat) & ~F.isnan(lng)
    return F.coalesce(ok, F.lit(False))
