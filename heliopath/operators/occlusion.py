"""Does a building, the terrain or a tunnel block the sun ray of a segment?

Answers are 1 (shade), 0 (clear) or NULL (uncertain or unknown). A NULL never
counts as shade. Geometry is planar; ``scene_points`` and ``scene_buildings``
bring geographic data onto one grid plane for the cell join, and the exact test
runs in the route's own plane.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import RAD, angle_between, planar_segment_m, project, rad, ray_polygon_m
from .spatial import RAY_CELL_M, cell, cells_of_box, explode_cells, explode_ray, nearest_any, nearest_within, settled, spread

RAY_M = 4500.0
PROBES_M = (250.0, 600.0, 1200.0, 2400.0)
MARGIN_M = 1.5
TUNNEL_M = 14.0
DEFAULT_TERRAIN_ERROR_M = 2.0


def with_ray(points: DataFrame, azimuth: str = "sun_azimuth") -> DataFrame:
    return points.withColumn("dir_x", F.sin(rad(azimuth))).withColumn("dir_y", F.cos(rad(azimuth)))


def square(cx, cy, half) -> Column:
    """Square footprint as an (x, y) array."""
    c = lambda v: F.col(v) if isinstance(v, str) else v
    corner = lambda i, j: F.struct((c(cx) + i * c(half)).alias("x"), (c(cy) + j * c(half)).alias("y"))
    return F.array(corner(-1, -1), corner(1, -1), corner(1, 1), corner(-1, 1))


def with_bounds(buildings: DataFrame, polygon: str = "polygon") -> DataFrame:
    pick = lambda fn, axis: fn(F.transform(polygon, lambda p: p[axis]))
    return buildings.withColumns({
        "min_x": pick(F.array_min, "x"), "max_x": pick(F.array_max, "x"),
        "min_y": pick(F.array_min, "y"), "max_y": pick(F.array_max, "y")})


def ray_hits(points: DataFrame, buildings: DataFrame, reach_m: float = RAY_M, by: list[str] | None = None,
             cell_m: float = RAY_CELL_M, building_columns: list[str] | None = None,
             point_columns: list[str] | None = None, distinct: bool = True,
             among: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(point, building) pairs whose ray meets the footprint, with hit_m.

    ``points``: point_id, x, y, dir_x, dir_y. ``buildings``: building_id,
    polygon and its bounds. Both sides spread over grid cells. Buildings wholly
    behind the ray are cut by their box before the polygon test. A pair meeting
    in several cells shows up once, unless ``distinct`` is off because what
    follows does not mind. ``among`` leaves out cells of rays that need no test.
    """
    by = by or []
    b_cols = ["polygon", *(building_columns or [])]
    p_cols = ["x", "y", "dir_x", "dir_y", *(point_columns or [])]
    p = explode_ray(spread(points.select("point_id", *by, *p_cols), "point_id"), "x", "y", F.col("dir_x") * reach_m, F.col("dir_y") * reach_m, cell_m)
    p = among(p) if among else p
    b = explode_cells(buildings.select("building_id", *by, "min_x", "max_x", "min_y", "max_y", *b_cols),
                      cells_of_box("min_x", "max_x", "min_y", "max_y", cell_m))
    ahead = (F.when(F.col("dir_x") > 0, F.col("max_x") >= F.col("x")).otherwise(F.col("min_x") <= F.col("x"))
             & F.when(F.col("dir_y") > 0, F.col("max_y") >= F.col("y")).otherwise(F.col("min_y") <= F.col("y")))
    # The ray passes the box's centre no farther than half the box's diagonal.
    across = F.abs(F.col("dir_x") * ((F.col("min_y") + F.col("max_y")) / 2 - F.col("y"))
                   - F.col("dir_y") * ((F.col("min_x") + F.col("max_x")) / 2 - F.col("x")))
    close = across <= F.hypot(F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y")) / 2 + 1e-6
    pairs = p.join(b, [*by, "cx", "cy"]).filter(ahead & close).drop("cx", "cy")
    hit = ray_polygon_m("x", "y", "dir_x", "dir_y", "polygon", reach_m)
    hits = settled(pairs, "hit_m", hit).filter(F.col("hit_m").isNotNull()).drop("polygon")
    return hits.dropDuplicates(["point_id", "building_id"]) if distinct else hits


def _by_cell(rays: DataFrame) -> DataFrame:
    """Cells of rays are small and meet many buildings: dealt out to all tasks, they are not put together by size."""
    return spread(rays, "cx", "cy")


def building_verdict(hits: DataFrame) -> DataFrame:
    """Per point: robust block, plausible block, largest clearance and error.

    ``hits`` needs hit_m, sun_altitude, road_z (NULL: the building's ground),
    ground, ground_error_m and the height envelope.
    """
    known = hits.filter(F.col("ground").isNotNull())
    road = F.coalesce(F.col("road_z"), F.col("ground"))
    z = road + F.tan(rad("sun_altitude")) * F.col("hit_m")
    err = F.greatest(F.lit(0.0), F.coalesce("ground_error_m", F.lit(0.0)))
    known = known.withColumn("_z", z).withColumn("_e", err)
    g, zc, e = F.col("ground"), F.col("_z"), F.col("_e")
    low = g + F.col("height_lower") - zc - e
    high = g + F.col("height_upper") - zc + e
    block = (zc >= g + F.col("min_height_upper") + e - MARGIN_M) & (low >= MARGIN_M)
    maybe = (zc >= g + F.col("min_height_lower") - e - MARGIN_M) & (high >= -MARGIN_M)
    return known.groupBy("point_id").agg(
        F.bool_or(block).alias("building_blocked"), F.bool_or(maybe & ~block).alias("building_uncertain"),
        F.max(low).alias("building_margin_m"), F.max("_e").alias("building_error_m"))


def terrain_verdict(probes: DataFrame, error: str | float = DEFAULT_TERRAIN_ERROR_M) -> DataFrame:
    """blocked / uncertain / clear / unknown from the probes along each ray.

    ``probes``: point_id, road_z, sun_altitude, probe_m, elevation (NULL = none).
    """
    e = F.greatest(F.lit(0.0), F.col(error) if isinstance(error, str) else F.lit(float(error)))
    clearance = F.max(F.col("elevation") - (F.col("road_z") + F.tan(rad("sun_altitude")) * F.col("probe_m")))
    out = probes.groupBy("point_id").agg(clearance.alias("clearance_m"), F.max("road_z").alias("_road"),
                                         F.max("sun_altitude").alias("_alt"), F.max(e).alias("_e"),
                                         F.bool_and(F.col("elevation").isNotNull()).alias("complete"))
    c, err = F.col("clearance_m"), F.col("_e")
    flat = F.col("_road").isNull() | F.col("_alt").isNull() | (F.col("_alt") <= 0)
    state = (F.when(flat, "clear").when(c.isNull(), "unknown").when(c > err, "blocked")
             .when(c >= -err, "uncertain").otherwise("clear"))
    return out.select("point_id", F.when(~flat, c).alias("clearance_m"), state.alias("terrain_state"), "complete")


def terrain_probes(points: DataFrame, samples: DataFrame, probes_m=PROBES_M, max_m: float = 180.0,
                   by: list[str] | None = None) -> DataFrame:
    """Elevation of the nearest sample at each probe distance along the ray."""
    by = by or []
    far = points.withColumn("_p", F.explode(F.array(*[F.lit(float(p)) for p in probes_m])))
    far = far.withColumn("probe_m", F.col("_p")).withColumn("probe_id", F.struct("point_id", "probe_m"))
    far = far.withColumn("x", F.col("x") + F.col("dir_x") * F.col("_p")).withColumn(
        "y", F.col("y") + F.col("dir_y") * F.col("_p"))
    near = nearest_within(far, samples, max_m, "probe_id", keep=["elevation"], by=by)
    keep = [c for c in ("road_z", "sun_altitude") if c in points.columns]
    return far.join(near.select("probe_id", "elevation"), "probe_id", "left").select(
        "point_id", *keep, "probe_m", "elevation")


def near_tunnel(points: DataFrame, tunnel_segments: DataFrame, max_m: float = TUNNEL_M,
                by: list[str] | None = None) -> DataFrame:
    """point_ids with either end of their segment within 14 m of a tunnel line.

    ``points``: point_id, x, y, x2, y2. ``tunnel_segments``: ax, ay, bx, by_. Places where several points
    end and lines that several tunnels share are tested once; a place lies in one cell, a line is listed in those within reach.
    """
    by = by or []
    ends = points.select("point_id", *by, F.explode(F.array(
        F.struct(F.col("x").alias("x"), F.col("y").alias("y")),
        F.struct(F.col("x2").alias("x"), F.col("y2").alias("y")))).alias("_e")).select("point_id", *by, "_e.*")
    size = 4 * max_m
    place, line = [*by, "x", "y"], [*by, "ax", "ay", "bx", "by_"]
    p = ends.select(*place).distinct().withColumns({"cx": cell("x", size), "cy": cell("y", size)})
    t = explode_ray(tunnel_segments.select(*line).distinct(), "ax", "ay", F.col("bx") - F.col("ax"), F.col("by_") - F.col("ay"), size,
                    margin=max_m * 1.001)
    hit = p.join(t, [*by, "cx", "cy"]).filter(planar_segment_m("x", "y", "ax", "ay", "bx", "by_") < max_m)
    return ends.join(hit.select(*place).distinct(), place, "left_semi").select("point_id").distinct()


def best_profile(points: DataFrame, profiles: DataFrame) -> DataFrame:
    """Terrain profile with the least km + angle/90 + index gap/10 per point.

    ``profiles`` holds at most 24 rows per route: route_id, profile_idx, v_idx,
    px, py, direction and payload columns; only complete ones take part.
    """
    payload = [c for c in profiles.columns if c not in ("route_id", "complete")]
    # Bounded: one small array per route travels to its points.
    table = profiles.filter("complete").groupBy("route_id").agg(F.collect_list(F.struct(*payload)).alias("_profiles"))

    def score(p: Column) -> Column:
        near = F.hypot(F.col("x") - p["px"], F.col("y") - p["py"]) / 1000.0
        turn = angle_between(p["direction"], "sun_azimuth") / 90.0
        return near + turn + F.abs(p["v_idx"] - F.col("seg_idx")) / 10.0

    scored = F.array_min(F.transform("_profiles", lambda p: F.struct(
        score(p).alias("score"), p["profile_idx"].alias("i"), p.alias("p"))))
    out = points.join(table, "route_id", "left").withColumn("_b", scored)
    return out.select(*[F.col(c) for c in points.columns], F.col("_b.score").alias("profile_score"),
                      *[F.col(f"_b.p.{c}").alias(c) for c in payload])


def verdict(altitude, tunnel, building_blocked, building_uncertain, terrain_state, cover_buildings=None,
            cover_terrain=None, cover_tunnels=None, cover_ground=None) -> Column:
    """Struct occlusion, shade_state, source, by fixed precedence.

    Night, tunnel, building with terrain, building, terrain, uncertain, unknown
    ground, clear, unknown. Missing coverage columns count as covered.
    """
    c = lambda v: F.col(v) if isinstance(v, str) else v
    flag = lambda v, default: F.lit(default) if v is None else F.coalesce(c(v), F.lit(default))
    buildings, terrain, tunnels = (flag(v, True) for v in (cover_buildings, cover_terrain, cover_tunnels))
    ground = flag(cover_ground, True)
    use_b, use_t = buildings & ground, terrain
    blocked_b = use_b & flag(building_blocked, False)
    unsure_b = use_b & flag(building_uncertain, False)
    state = F.coalesce(c(terrain_state), F.lit("none"))
    blocked_t = use_t & (state == "blocked")
    unsure_t = use_t & state.isin("uncertain", "unknown")

    def out(occlusion, name: str, source: str) -> Column:
        return F.struct(F.lit(occlusion).cast("double").alias("occlusion"), F.lit(name).alias("shade_state"),
                        F.lit(source).alias("source"))

    return (F.when(c(altitude) <= -6, out(1.0, "night", "night"))
            .when(tunnels & flag(tunnel, False), out(1.0, "confirmed-shade", "tunnel"))
            .when(blocked_b & blocked_t, out(1.0, "confirmed-shade", "building+terrain"))
            .when(blocked_b, out(1.0, "confirmed-shade", "building"))
            .when(blocked_t, out(1.0, "confirmed-shade", "terrain"))
            .when(unsure_b | unsure_t, out(None, "uncertain", "scene-uncertain"))
            .when(~ground, out(None, "unknown", "heuristic"))
            .when(buildings | terrain | tunnels, out(0.0, "confirmed-clear", "scene-clear"))
            .otherwise(out(None, "unknown", "heuristic")))


def planar_occlusion(points: DataFrame, buildings: DataFrame, samples: DataFrame, tunnels: DataFrame | None = None,
                     terrain_error_m: float = DEFAULT_TERRAIN_ERROR_M, road: DataFrame | None = None) -> DataFrame:
    """Verdict for points of one plane: point_id, x, y, sun_azimuth, sun_altitude.

    ``road`` gives (point_id, road_z); otherwise the nearest sample at any distance.
    Every point is its own terrain profile, used only when all probes are known. Buildings alike in all that the
    verdict looks at are tested once.
    """
    if road is None:
        road = nearest_any(points, samples, "point_id", keep=["elevation"]).select(
            "point_id", F.col("elevation").alias("road_z"))
    p = with_ray(points).join(road, "point_id", "left")
    payload = ["ground", "ground_error_m", "height_lower", "height_upper", "min_height_lower", "min_height_upper"]
    roofs = buildings.groupBy("polygon", "min_x", "max_x", "min_y", "max_y", *payload).agg(F.min("building_id").alias("building_id"))
    hits = ray_hits(p, roofs, building_columns=payload, point_columns=["sun_altitude", "road_z"], distinct=False, among=_by_cell)
    built = building_verdict(hits)
    ground = terrain_verdict(terrain_probes(p, samples), terrain_error_m).filter("complete").drop("complete")
    out = p.join(built, "point_id", "left").join(ground, "point_id", "left")
    if tunnels is not None:
        inside = near_tunnel(points, tunnels).withColumn("tunnel", F.lit(True))
        out = out.join(inside, "point_id", "left")
    else:
        out = out.withColumn("tunnel", F.lit(False))
    out = out.withColumn("_v", verdict("sun_altitude", "tunnel", "building_blocked", "building_uncertain", "terrain_state"))
    return out.select("point_id", "road_z", F.coalesce("building_blocked", F.lit(False)).alias("building_blocked"),
                      F.coalesce("building_uncertain", F.lit(False)).alias("building_uncertain"),
                      "building_margin_m", "terrain_state", "clearance_m", "_v.*")
