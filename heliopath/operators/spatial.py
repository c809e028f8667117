"""Distance joins as equi-joins on grid cells, followed by the exact test."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import EARTH_RADIUS_M, RAD, along, col, haversine_m, lng_scale, segment_fraction
from ..session import cut_lineage

RAY_CELL_M = 250.0


def cell(value, size: float) -> Column:
    return F.floor(col(value) / size)


def cells_around(x, y, size: float) -> Column:
    """The 3 x 3 block of cells around a point."""
    cx, cy = cell(x, size), cell(y, size)
    return F.array(*[F.struct((cx + i).alias("cx"), (cy + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])


def cells_of_box(min_x, max_x, min_y, max_y, size: float) -> Column:
    rows = F.sequence(cell(min_y, size), cell(max_y, size))
    return F.flatten(F.transform(F.sequence(cell(min_x, size), cell(max_x, size)),
                                 lambda cx: F.transform(rows, lambda cy: F.struct(cx.alias("cx"), cy.alias("cy")))))


def explode_ray(df: DataFrame, x, y, dx, dy, size: float, margin: float = 0.0) -> DataFrame:
    """One row per grid cell (cx, cy) the straight line x, y .. x+dx, y+dy passes, or comes within ``margin`` of.

    Per column of cells the rows it spans are listed. A hit lies both in a passed
    cell and in a cell of the target's box, so the target needs no margin. Nearly
    vertical lines take their whole span of rows.
    """
    out = df.withColumns({"_rx": col(x), "_ry": col(y), "_rdx": col(dx), "_rdy": col(dy)})
    x0, y0, x1, y1 = F.col("_rx"), F.col("_ry"), F.col("_rx") + F.col("_rdx"), F.col("_ry") + F.col("_rdy")
    out = out.withColumns({"_le": F.least(x0, x1), "_ri": F.greatest(x0, x1), "_lo": F.least(y0, y1), "_hi": F.greatest(y0, y1),
                           "_sl": F.when(F.abs("_rdx") > 1e-6, F.col("_rdy") / F.col("_rdx"))})
    out = out.withColumn("cx", F.explode(F.sequence(F.floor((F.col("_le") - margin) / size - 1e-9), F.floor((F.col("_ri") + margin) / size + 1e-9))))
    at = lambda edge: F.least(F.col("_hi"), F.greatest(F.col("_lo"), y0 + (edge - x0) * F.col("_sl")))
    out = out.withColumns({"_ya": at(F.greatest(F.col("_le"), F.col("cx") * size - margin)),
                           "_yb": at(F.least(F.col("_ri"), (F.col("cx") + 1) * size + margin))})
    # Without a slope the bounds above are the span's ends, so both are taken.
    low = F.when(F.col("_sl").isNull(), F.col("_lo")).otherwise(F.least("_ya", "_yb"))
    high = F.when(F.col("_sl").isNull(), F.col("_hi")).otherwise(F.greatest("_ya", "_yb"))
    out = out.withColumn("cy", F.explode(F.sequence(F.floor((low - margin) / size - 1e-9), F.floor((high + margin) / size + 1e-9))))
    return out.drop("_rx", "_ry", "_rdx", "_rdy", "_le", "_ri", "_lo", "_hi", "_sl", "_ya", "_yb")


def explode_cells(df: DataFrame, cells: Column) -> DataFrame:
    return df.withColumn("_c", F.explode(cells)).withColumn("cx", F.col("_c.cx")).withColumn(
        "cy", F.col("_c.cy")).drop("_c")


def spread(df: DataFrame, *key: str) -> DataFrame:
    """Distribute rows by key before each is expanded into several.

    The rows are still few and narrow here, the later aggregate on the key needs
    this distribution anyway, and an input of few splits gets its tasks.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *key)


def settled(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column once, so that a later filter does not repeat it.

    Filters move below plain projections and take the expression with them; a
    generator of one element stops that.
    """
    return df.withColumn(name, F.explode(F.array(value)))


def _best_within(points: DataFrame, samples: DataFrame, radius: float, point_id: str, keep: list[str],
                 sample_id: str, by: list[str]) -> DataFrame:
    near = explode_cells(points.select(point_id, *by, F.col("x").alias("_x"), F.col("y").alias("_y")),
                         cells_around("_x", "_y", radius))
    at = samples.select(*by, sample_id, *[c for c in keep if c != sample_id], F.col("x").alias("_sx"),
                        F.col("y").alias("_sy"), cell("x", radius).alias("cx"), cell("y", radius).alias("cy"))
    gap = F.hypot(F.col("_x") - F.col("_sx"), F.col("_y") - F.col("_sy"))
    pairs = near.join(at, [*by, "cx", "cy"]).withColumn("distance", gap).filter(F.col("distance") <= radius)
    best = pairs.groupBy(point_id).agg(F.min_by(
        F.struct(*[F.col(c) for c in dict.fromkeys([sample_id, *keep])], "distance"),
        F.struct("distance", sample_id)).alias("_best"))
    return best.select(point_id, "_best.*")


def nearest_within(points: DataFrame, samples: DataFrame, max_m: float, point_id: str = "point_id",
                   sample_id: str = "sample_id", keep: list[str] | None = None,
                   by: list[str] | None = None) -> DataFrame:
    """Nearest planar sample of each point within ``max_m``; ties by sample id.

    Points without one are absent; join the result back with a left join.
    """
    return _best_within(points, samples, max_m, point_id, keep or [], sample_id, by or [])


def nearest_of_places(points: DataFrame, samples: DataFrame, max_m: float, point_id: str = "point_id",
                      sample_id: str = "sample_id", keep: list[str] | None = None) -> DataFrame:
    """As ``nearest_within``, for points of which many share a place: each place is looked up once."""
    places = points.select("x", "y").distinct().withColumn("_place", F.struct("x", "y"))
    near = nearest_within(places, samples, max_m, "_place", sample_id, keep)
    found = near.select("_place.x", "_place.y", *[c for c in near.columns if c != "_place"])
    return points.select(point_id, "x", "y").join(found, ["x", "y"]).drop("x", "y")


BROADCAST_CELLS = 50_000


def _occupied(samples: DataFrame, size: float, by: list[str], level: int) -> DataFrame:
    """Grid cells of side size * 2^level that hold a sample."""
    at = lambda c: F.shiftright(cell(c, size).cast("long"), level)
    return samples.select(*by, at("x").alias("cx"), at("y").alias("cy")).distinct()


def _far_best(points: DataFrame, samples: DataFrame, size: float, extent: tuple, point_id: str, keep: list[str],
              sample_id: str, by: list[str]) -> DataFrame:
    """Nearest samples of points that have none close by, down a pyramid of occupied cells.

    A cell holds at least one sample, so the farthest corner of the best cell
    bounds a point's distance, and cells whose nearest point lies beyond go.
    A handful of cells per point survive at every level; only samples in the
    last ones are compared. Upper levels have a known small number of cells.
    """
    min_x, max_x, min_y, max_y = extent
    top = 0
    while max(max_x - min_x, max_y - min_y) > size * 2**top:
        top += 1
    first = lambda v: int(v // size) >> top
    roots = F.array(*[F.struct(F.lit(i).cast("long").alias("cx"), F.lit(j).cast("long").alias("cy"))
                      for i in range(first(min_x), first(max_x) + 1) for j in range(first(min_y), first(max_y) + 1)])
    here = points.select(point_id, *by, F.col("x").alias("_x"), F.col("y").alias("_y"))
    found = explode_cells(here, roots)
    own = Window.partitionBy(point_id)
    for level in range(top, -1, -1):
        cells, side = _occupied(samples, size, by, level), size * 2**level
        if not by and (2 ** (top - level) + 2) ** 2 <= BROADCAST_CELLS:
            cells = F.broadcast(cells)
        found = found.join(cells, [*by, "cx", "cy"])
        away = lambda v, c: (F.greatest(F.lit(0.0), F.col(c) * side - F.col(v), F.col(v) - (F.col(c) + 1) * side),
                             F.greatest(F.abs(F.col(c) * side - F.col(v)), F.abs(F.col(v) - (F.col(c) + 1) * side)))
        (near_x, far_x), (near_y, far_y) = away("_x", "cx"), away("_y", "cy")
        found = found.withColumn("_far", F.min(F.hypot(far_x, far_y)).over(own)).filter(
            F.hypot(near_x, near_y) <= F.col("_far") + 1e-6).drop("_far")
        if level % 4 == 0:
            found = cut_lineage(found)
        if level:
            quarters = F.array(*[F.struct((F.col("cx") * 2 + i).alias("cx"), (F.col("cy") * 2 + j).alias("cy"))
                                 for i in (0, 1) for j in (0, 1)])
            found = found.withColumn("_q", F.explode(quarters)).withColumns({"cx": F.col("_q.cx"), "cy": F.col("_q.cy")}).drop("_q")
    at = samples.select(*by, sample_id, *[c for c in keep if c != sample_id], F.col("x").alias("_sx"), F.col("y").alias("_sy"),
                        cell("x", size).cast("long").alias("cx"), cell("y", size).cast("long").alias("cy"))
    pairs = found.join(at, [*by, "cx", "cy"]).withColumn(
        "distance", F.hypot(F.col("_x") - F.col("_sx"), F.col("_y") - F.col("_sy")))
    best = pairs.groupBy(point_id).agg(F.min_by(
        F.struct(*[F.col(c) for c in dict.fromkeys([sample_id, *keep])], "distance"), F.struct("distance", sample_id)).alias("_best"))
    return best.select(point_id, "_best.*")


def nearest_any(points: DataFrame, samples: DataFrame, point_id: str = "point_id", sample_id: str = "sample_id",
                keep: list[str] | None = None, by: list[str] | None = None, first_m: float = 200.0) -> DataFrame:
    """Nearest sample at any distance; ties by sample id.

    One round settles exactly the points with a sample within ``first_m``; the
    others go down a pyramid of occupied cells. Runs jobs when called: it needs
    the extent, and what is left is checkpointed.
    """
    keep, by = keep or [], by or []
    ends = [F.min("x"), F.max("x"), F.min("y"), F.max("y")]
    extent = samples.agg(*ends).first()
    best = _best_within(points, samples, first_m, point_id, keep, sample_id, by)
    if extent[0] is None:
        return best
    tagged = cut_lineage(points.join(best, point_id, "left"))
    names = list(dict.fromkeys([sample_id, *keep, "distance"]))
    found = tagged.filter(F.col("distance").isNotNull()).select(point_id, *names)
    left = tagged.filter(F.col("distance").isNull() & F.col("x").isNotNull() & F.col("y").isNotNull()).select(*points.columns)
    if left.isEmpty():
        return found
    return found.unionByName(_far_best(left, samples, first_m, tuple(extent), point_id, keep, sample_id, by))


CELL_RADII = 8


def _segments_near(points: DataFrame, segments: DataFrame, radius: float, point_id: str, carry: list[str]) -> DataFrame:
    """``points`` with their nearest segment within ``radius``, NULL for none.

    A point lies in one cell, eight radii wide; a segment is listed in the cells that come
    within the radius. So neither points nor pairs multiply, and as a cell's pairs meet in one
    task, the winner is found there without another shuffle.
    """
    size, slack = CELL_RADII * radius, radius / 111000.0
    names = ["seg_idx", "lat1", "lng1", "lat2", "lng2", *carry]
    near = explode_geo_points(points, "lat", "lng", size, around=False, slack_deg=slack)
    s = explode_geo_segments(segments.select("route_id", *names), size, slack, margin=radius * 1.001)
    cells = ["route_id", "band", "cx", "cy"]
    pairs = near.withColumn("_kx", lng_scale("lat")).join(s, cells, "left")
    pairs = settled(pairs, "t", segment_fraction("lat", "lng", "lat1", "lng1", "lat2", "lng2", "_kx"))
    pairs = pairs.withColumn("snap_lat", along("lat1", "lat2", "t")).withColumn("snap_lng", along("lng1", "lng2", "t"))
    pairs = settled(pairs, "distance", haversine_m("lat", "lng", "snap_lat", "snap_lng"))
    # Whole micrometres: where two segments meet, the lower one wins.
    order = F.when(F.col("distance") <= radius, F.struct(F.round("distance", 6), F.col("seg_idx")))
    fields = ["seg_idx", "t", "snap_lat", "snap_lng", "distance", "lat1", "lng1", "lat2", "lng2", *carry]
    own = [c for c in points.columns if c != "route_id"]
    best = pairs.groupBy(*cells, *own).agg(F.min_by(F.struct(*fields), order).alias("_hit"))
    return best.select(*points.columns, "_hit.*")


def nearest_segment(points: DataFrame, segments: DataFrame, point_id: str = "point_id",
                    carry: list[str] | None = None, first_m: float = 400.0, only_within: float | None = None) -> DataFrame:
    """Nearest segment of its own route for every (route_id, lat, lng) point.

    Ties go to the lower segment. With ``only_within`` one lazy round suffices
    and farther points are absent; otherwise radii grow as in ``nearest_any``, and from the
    second round on only routes that still have open points take part.
    """
    carry = carry or []
    left = points.select(point_id, "route_id", "lat", "lng")
    names = [point_id, "seg_idx", "t", "snap_lat", "snap_lng", "distance", "lat1", "lng1", "lat2", "lng2", *carry]
    hit = F.col("distance").isNotNull()
    if only_within is not None:
        return _segments_near(left, segments, only_within, point_id, carry).filter(hit).select(*names)
    # Points of routes without segments have no nearest one.
    s = segments.select("route_id", "seg_idx", "lat1", "lng1", "lat2", "lng2", *carry)
    found, radius = [], first_m
    while True:
        tagged = cut_lineage(_segments_near(left, s, radius, point_id, carry))
        found.append(tagged.filter(hit).select(*names))
        left = tagged.filter(~hit).select(*left.columns)
        if radius > 2.1e7 or left.isEmpty():
            break
        s = s.join(left.select("route_id").distinct(), "route_id", "left_semi")
        s = cut_lineage(s)
        left = cut_lineage(left.join(s.select("route_id").distinct(), "route_id", "left_semi").filter(
            F.col("lat").isNotNull() & F.col("lng").isNotNull()))
        radius *= 8
    return reduce(DataFrame.unionByName, found)


def _band_scale(band: Column, slack_deg: float = 0.0) -> Column:
    widest = F.least(F.lit(89.9), F.greatest(F.abs(band), F.abs(band + 1)) + 0.01 + slack_deg)
    return F.cos(widest * RAD) * (RAD * EARTH_RADIUS_M)


def explode_geo_points(df: DataFrame, lat, lng, radius: float, around: bool = True, slack_deg: float = 0.0) -> DataFrame:
    """Rows per cell (band, cx, cy) of a coordinate on a world grid of ``radius`` cells.

    Every degree of latitude has its own east-west scale, never longer than the
    ground, so neighbours within ``radius`` are always in adjacent cells. With
    ``around`` the 3 x 3 block is given, in both bands where an edge is near.
    """
    lat, lng = col(lat), col(lng)
    cy = F.floor(lat * (RAD * EARTH_RADIUS_M) / radius)
    if not around:
        out = df.withColumn("band", F.floor(lat))
        return out.withColumns({"cx": F.floor(lng * _band_scale(F.col("band"), slack_deg) / radius), "cy": cy})
    slack = radius / 111000.0
    out = df.withColumn("band", F.explode(F.array_distinct(F.array(F.floor(lat - slack), F.floor(lat + slack)))))
    out = out.withColumns({"_gx": F.floor(lng * _band_scale(F.col("band")) / radius), "_gy": cy})
    shift = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    out = out.withColumn("_s", F.explode(shift))
    return out.withColumns({"cx": F.col("_gx") + F.col("_s.i"), "cy": F.col("_gy") + F.col("_s.j")}).drop("_gx", "_gy", "_s")


def explode_geo_segments(df: DataFrame, radius: float, slack_deg: float = 0.0, margin: float = 0.0) -> DataFrame:
    """Rows per world-grid cell a (lat1, lng1)-(lat2, lng2) segment passes, or comes within ``margin`` metres of.

    Every band the segment touches counts, and with ``slack_deg`` also a band
    that begins within that many degrees; points of a ``margin`` take the same slack.
    """
    south, north = F.least("lat1", "lat2"), F.greatest("lat1", "lat2")
    out = df.withColumn("band", F.explode(F.sequence(F.floor(south - slack_deg), F.floor(north + slack_deg))))
    out = out.withColumn("_k", _band_scale(F.col("band"), slack_deg))
    y, k = RAD * EARTH_RADIUS_M, F.col("_k")
    return explode_ray(out, F.col("lng1") * k, F.col("lat1") * y, (F.col("lng2") - F.col("lng1")) * k,
                       (F.col("lat2") - F.col("lat1")) * y, radius, margin).drop("_k")
