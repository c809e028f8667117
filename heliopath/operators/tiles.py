"""Which scene tiles routes need, what is missing, and how covered segments are."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import EARTH_RADIUS_M, RAD, destination, project, tile_of
from ..session import cut_lineage
from ..streaming.blocks import running
from .paths import BLOCK as BLOCK_ROWS
from .paths import with_next

RAY_M = 4500.0
PROBES_M = (250.0, 600.0, 1200.0, 2400.0)
EDGE_M = 200.0
DEFAULT_GRID = (41.0, -74.0, math.cos(42.0 * RAD))


def safe_tiles(lat, lng, grid=DEFAULT_GRID, size_m: float = 5000.0) -> Column:
    """The tile of a point, and its neighbours when an edge is near."""
    x, y = project(lat, lng, grid[0], grid[1], grid[2])
    tx, ty = F.floor(x / size_m), F.floor(y / size_m)
    margin = min(EDGE_M, size_m * 0.04)

    def toward(value: Column, tile: Column) -> Column:
        local = value - tile * size_m
        return F.when(local < margin, -1).when(local > size_m - margin, 1).otherwise(0)

    dx, dy = toward(x, tx), toward(y, ty)
    tile = lambda a, b: F.struct(a.cast("long").alias("tx"), b.cast("long").alias("ty"))
    return F.array_distinct(F.array(tile(tx, ty), tile(tx + dx, ty), tile(tx, ty + dy), tile(tx + dx, ty + dy)))


def ray_distances(size_m: float = 5000.0, reach_m: float = RAY_M) -> list[float]:
    step = max(500.0, min(1000.0, size_m / 5))
    inner = [step * i for i in range(1, math.ceil(reach_m / step))]
    return [0.0, *[d for d in inner if d < reach_m], reach_m]


def required_tiles(vertices: DataFrame, profiles: DataFrame, grid=DEFAULT_GRID, size_m: float = 5000.0,
                   reach_m: float = RAY_M) -> DataFrame:
    """Distinct (route_id, tx, ty): road tiles and tiles crossed by sun rays.

    ``profiles``: route_id, lat, lng, sun_azimuth of the sampled anchors.
    """
    road = vertices.select("route_id", F.explode(safe_tiles("lat", "lng", grid, size_m)).alias("_t"))
    reach = profiles.withColumn("_m", F.explode(F.array(*[F.lit(d) for d in ray_distances(size_m, reach_m)])))
    lat, lng = destination("lat", "lng", "sun_azimuth", "_m")
    reach = reach.select("route_id", lat.alias("_lat"), lng.alias("_lng"))
    rays = reach.select("route_id", F.explode(safe_tiles("_lat", "_lng", grid, size_m)).alias("_t"))
    return road.unionByName(rays).select("route_id", "_t.tx", "_t.ty").distinct()


def tile_status(required: DataFrame, available: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """Each required tile as loaded, failed or missing."""
    have = available.select("tx", "ty").distinct().withColumn("_have", F.lit(True))
    out = required.join(have, ["tx", "ty"], "left")
    if failed is not None:
        out = out.join(failed.select("tx", "ty").distinct().withColumn("_failed", F.lit(True)), ["tx", "ty"], "left")
    else:
        out = out.withColumn("_failed", F.lit(None).cast("boolean"))
    status = F.when(F.col("_have").isNull(), "missing").when(F.col("_failed"), "failed").otherwise("loaded")
    return out.withColumn("status", status).drop("_have", "_failed")


def scan_required(tiles: DataFrame, required: DataFrame) -> DataFrame:
    """Only the rows of the needed tiles; on a table partitioned by tx, ty the
    key set prunes the scan at run time."""
    return tiles.join(required.select("tx", "ty").distinct(), ["tx", "ty"], "left_semi")


def scene_guard(length_m, south, north, west, east, area_km2, tile_count, total_area_km2=None,
                max_route_m: float = 250000.0, max_span_deg: float = 1.5, max_area_km2: float = 100.0,
                max_tiles: int = 8, max_total_km2: float = 400.0) -> Column:
    """Why a live scene is refused: ROUTE_TOO_LONG, TOO_MANY_TILES or NULL."""
    c = lambda v: F.col(v) if isinstance(v, str) else v
    split = (c(north) - c(south) > max_span_deg) | (c(east) - c(west) > max_span_deg) | (c(area_km2) > max_area_km2)
    total = F.coalesce(c(total_area_km2), c(area_km2)) if total_area_km2 is not None else c(area_km2)
    many = F.when(split, c(tile_count) > max_tiles).otherwise(False) | (total > max_total_km2)
    return F.when(c(length_m) > max_route_m, "ROUTE_TOO_LONG").when(many, "TOO_MANY_TILES")


def precomputed_guard(length_m, tile_count, max_route_m: float = 250000.0, max_tiles: int = 256) -> Column:
    c = lambda v: F.col(v) if isinstance(v, str) else v
    return F.when(c(length_m) > max_route_m, "ROUTE_TOO_LONG").when(
        c(tile_count) > max_tiles, "SCENE_TILE_LIMIT_EXCEEDED")


def box_gap_m(a: tuple, b: tuple) -> Column:
    """Planar gap of two boxes (min_x, max_x, min_y, max_y)."""
    c = lambda v: F.col(v) if isinstance(v, str) else v
    dx = F.greatest(c(a[0]) - c(b[1]), c(b[0]) - c(a[1]), F.lit(0.0))
    dy = F.greatest(c(a[2]) - c(b[3]), c(b[2]) - c(a[3]), F.lit(0.0))
    return F.hypot(dx, dy)


def reason_code(code, message) -> Column:
    """Explicit code, else read from the error text; the order matters."""
    text = F.lower(F.coalesce(F.col(message) if isinstance(message, str) else message, F.lit("")))
    given = F.trim(F.coalesce(F.col(code) if isinstance(code, str) else code, F.lit("")))
    has = lambda *words: F.greatest(*[text.contains(w) for w in words], F.lit(False))
    return (F.when(given != "", given).when(has("abort", "cancel"), "SCENE_REQUEST_ABORTED")
            .when(has("timeout") & has("dem"), "DEM_FAILURE").when(has("timeout"), "SCENE_PACK_DOWNLOAD_TIMEOUT")
            .when(has("range", "bbox", "250"), "ROUTE_TOO_LONG").when(has("checksum"), "SCENE_PACK_CHECKSUM_FAILURE")
            .when(has("decompress", "worker"), "SCENE_DECOMPRESS_FAILURE").otherwise("SCENE_DATA_UNAVAILABLE"))


def split_by_length(vertices: DataFrame, chunk_m: float = 5000.0) -> DataFrame:
    """Cut routes into pieces of at least ``chunk_m``; neighbours share a vertex.

    The counter restarts at each cut, so this is a running state over one
    route's vertices in order. Partitions are sorted and streamed through with a
    constant amount of memory. Routes too long for a scene are cut like any
    other; that they get none is said by the guard on their length.
    """
    import numpy as np
    import pandas as pd

    pairs = with_next(vertices.select("route_id", "v_idx", "lat", "lng"), ["lat", "lng"])
    from ..functions.geo import haversine_m

    rows = pairs.select(
        "route_id", "v_idx", haversine_m("lat", "lng", "lat_next", "lng_next").alias("m"))

    def cut(batches):
        route, piece, run = None, 0, 0.0  # of the route that goes on: its piece and the metres of it so far
        for pdf in batches:
            owner, metres = pdf["route_id"].to_numpy(), pdf["m"].to_numpy()
            out = np.empty(len(owner), np.int64)
            begins = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            for at, end in zip(begins, np.append(begins[1:], len(owner))):
                if owner[at] != route:
                    route, piece, run = owner[at], 0, 0.0
                while at < end:
                    # The piece ends with the segment that reaches its length; lengths add up anew from each cut.
                    ahead = min(end, at + 1024)
                    total = np.cumsum(np.concatenate([[run], metres[at:ahead]]))[1:]
                    reached = int(np.argmax(total >= chunk_m)) if (total >= chunk_m).any() else -1
                    stop = ahead if reached < 0 else at + reached + 1
                    out[at:stop] = piece
                    piece, run = (piece, total[-1]) if reached < 0 else (piece + 1, 0.0)
                    at = stop
            yield pd.DataFrame({"route_id": owner, "v_idx": pdf["v_idx"], "piece": out})

    ordered = rows.repartition("route_id").sortWithinPartitions("route_id", "v_idx")
    segments = ordered.mapInPandas(cut, "route_id long, v_idx long, piece long")
    return segments.withColumnRenamed("v_idx", "seg_idx")


def _degree(column: str) -> Column:
    return F.floor(column).cast("long")


def region_runs(vertices: DataFrame, regions: DataFrame) -> DataFrame:
    """Contiguous vertex runs inside region boxes, one vertex wider on each side.

    ``regions``: region, south, west, north, east. Boxes are listed by the whole
    degrees they touch and vertices meet them there. Runs are numbered block by block.
    """
    n = vertices.groupBy("route_id").agg(F.max("v_idx").alias("_last"))
    box = regions.select("region", "south", "west", "north", "east").withColumn(
        "_y", F.explode(F.sequence(_degree("south"), _degree("north")))).withColumn(
        "_x", F.explode(F.sequence(_degree("west"), _degree("east"))))
    at = vertices.select("route_id", "v_idx", "lat", "lng", _degree("lat").alias("_y"), _degree("lng").alias("_x"))
    joined = at.join(box, ["_y", "_x"]).filter(F.col("lat").between(F.col("south"), F.col("north"))
                                               & F.col("lng").between(F.col("west"), F.col("east")))
    joined = joined.select("route_id", "region", "v_idx", F.struct("route_id", "region").alias("_k"))
    counted = running(joined, "_n", F.lit(1), "sum", "_k", ["v_idx"], BLOCK_ROWS)
    runs = counted.groupBy("route_id", "region", (F.col("v_idx") - F.col("_n")).alias("_g")).agg(
        F.min("v_idx").alias("_a"), F.max("v_idx").alias("_z"))
    runs = runs.join(n, "route_id").select(
        "route_id", "region", F.greatest(F.lit(0), F.col("_a") - 1).alias("run_start"),
        F.least(F.col("_last"), F.col("_z") + 1).alias("run_end"))
    return runs.filter("run_end > run_start")


def nearest_by_index(segments: DataFrame, marks: DataFrame, carry: list[str], prefix: str) -> DataFrame:
    """Add ``<prefix>_gap`` and the carried columns of the mark nearest by index, the earlier one on a tie.

    ``segments`` has route_id and seg_idx, ``marks`` route_id and v_idx. The last
    mark at or before each segment and the first behind it are found as running
    values over both in order, so a route may have any number of either.
    """
    names = [c for c in segments.columns if c != "route_id"]
    own = segments.select("route_id", F.col("seg_idx").alias("_i"), F.lit(1).alias("_s"), F.struct(*names).alias("_row"))
    both = own.unionByName(marks.select("route_id", F.col("v_idx").alias("_i"), F.lit(0).alias("_s"),
                                        F.struct("v_idx", *carry).alias("_mark")), allowMissingColumns=True)
    both = cut_lineage(both)  # read several times by the running values
    both = running(both, "_before", F.col("_mark"), "last", "route_id", ["_i", "_s"], BLOCK_ROWS).withColumn("_back", -F.col("_i"))
    both = running(both, "_behind", F.col("_mark"), "last", "route_id", ["_back", "_s"], BLOCK_ROWS)
    gap = lambda side: F.abs(F.col(f"{side}.v_idx") - F.col("_i"))
    first = F.coalesce(gap("_before") <= gap("_behind"), F.col("_before").isNotNull())
    near = F.when(first, F.col("_before")).otherwise(F.col("_behind"))
    out = both.filter("_s = 1").withColumn("_near", near)
    return out.select("route_id", "_row.*", F.abs(F.col("_near.v_idx") - F.col("_i")).alias(f"{prefix}_gap"),
                      *[F.col(f"_near.{c}").alias(f"{prefix}_{c}") for c in carry])


def segment_coverage(segments: DataFrame, loaded: DataFrame, profiles: DataFrame, buildings_near: DataFrame | None = None,
                     grid=DEFAULT_GRID, size_m: float = 5000.0) -> DataFrame:
    """Road tile, ray tile, terrain and ground coverage of each segment.

    ``segments``: route_id, seg_idx, lat1.., last_seg. ``loaded``: route_id, tx,
    ty. ``profiles``: route_id, v_idx, lat, lng, sun_azimuth, complete (all
    elevations known). A segment takes the complete profile nearest by index,
    the earlier one on a tie.
    """
    have = loaded.select("route_id", "tx", "ty").distinct().withColumn("_have", F.lit(True))
    t1, t2 = tile_of("lat1", "lng1", grid, size_m), tile_of("lat2", "lng2", grid, size_m)
    ends = segments.select("route_id", "seg_idx", "last_seg", F.explode(F.array(
        F.struct(t1[0].alias("tx"), t1[1].alias("ty")), F.struct(t2[0].alias("tx"), t2[1].alias("ty")))).alias("_t"))
    ends = ends.select("route_id", "seg_idx", "last_seg", "_t.tx", "_t.ty").join(have, ["route_id", "tx", "ty"], "left")
    road = ends.groupBy("route_id", "seg_idx", "last_seg").agg(
        F.bool_and(F.coalesce("_have", F.lit(False))).alias("tiles"))
    ray = profiles.filter("complete").withColumn("_m", F.explode(F.array(*[F.lit(float(d)) for d in (0.0, *PROBES_M, RAY_M)])))
    lat, lng = destination("lat", "lng", "sun_azimuth", "_m")
    ray = ray.withColumn("_lat", lat).withColumn("_lng", lng)
    tx, ty = tile_of("_lat", "_lng", grid, size_m)
    ray = ray.withColumn("tx", tx).withColumn("ty", ty).join(have, ["route_id", "tx", "ty"], "left")
    ray = ray.groupBy("route_id", "v_idx").agg(F.bool_and(F.coalesce("_have", F.lit(False))).alias("ray_tiles"))
    count = profiles.groupBy("route_id").agg(F.count(F.lit(1)).alias("n_profiles"))
    out = nearest_by_index(road, ray, ["ray_tiles"], "_near").join(count, "route_id", "left")
    spacing = (F.col("last_seg") + 2) / F.greatest(F.lit(1), F.coalesce("n_profiles", F.lit(0)) - 1)
    reach = F.greatest(F.lit(2.0), spacing * 1.5)
    ray_ok = F.coalesce(F.col("_near_ray_tiles"), F.lit(False))
    close = F.coalesce(F.col("_near_gap") <= reach, F.lit(False))
    out = out.select("route_id", "seg_idx", "tiles", ray_ok.alias("ray_tiles"),
                     (F.col("tiles") & ray_ok & close).alias("terrain"), (F.col("tiles") & ray_ok).alias("buildings"),
                     reach.alias("_reach"))
    if buildings_near is not None:
        # route_id, v_idx of profiles hit by a building without ground elevation
        bad = buildings_near.select("route_id", "v_idx").distinct()
        out = nearest_by_index(out, bad, [], "_bad")
        out = out.withColumn("building_ground", F.col("buildings") & ~F.coalesce(F.col("_bad_gap") <= F.col("_reach"), F.lit(False)))
        out = out.drop("_bad_gap")
    else:
        out = out.withColumn("building_ground", F.col("buildings"))
    return out.drop("_reach").withColumn("tunnels", F.col("tiles"))


def coverage_summary(coverage: DataFrame) -> DataFrame:
    """Covered segments, their ratio and the precision / partial flags."""
    covered = F.col("terrain") & F.col("building_ground")
    out = coverage.groupBy("route_id").agg(
        F.count(F.lit(1)).alias("segment_count"), F.count_if(covered).alias("covered_segments"),
        F.bool_and(covered).alias("precision_ready"))
    return out.withColumn("segment_ratio", F.col("covered_segments") / F.col("segment_count")).withColumn(
        "partial", ~F.col("precision_ready") & (F.col("covered_segments") > 0))


def merge_coverage(parts: DataFrame) -> DataFrame:
    """Union of regional coverage: a flag holds if any region covers it."""
    flags = ["buildings", "tunnels", "terrain", "building_ground"]
    return parts.groupBy("route_id", "seg_idx").agg(*[F.bool_or(f).alias(f) for f in flags])


def merge_regions(parts: DataFrame) -> DataFrame:
    """Regional parts of a route: largest terrain error, sums, strict confidence."""
    sums = ["total_buildings", "missing_tiles", "requested_tiles", "loaded_tiles"]
    return parts.groupBy("route_id").agg(
        F.count(F.lit(1)).alias("regions"),
        F.coalesce(F.max("terrain_error_m"), F.lit(2.0)).alias("terrain_error_m"),
        F.when(F.bool_and(F.coalesce(F.col("confidence") == 0.90, F.lit(False))), 0.90).alias("confidence"),
        F.bool_and("precision_ready").alias("all_ready"), *[F.sum(s).alias(s) for s in sums])


def first_of_each(rows: DataFrame, key: Column | str, order: list[str]) -> DataFrame:
    """Keep the first row of every key, e.g. the first copy of a building.

    An aggregate instead of a window, so copies combine before the shuffle.
    """
    keyed = rows.withColumn("_key", F.col(key) if isinstance(key, str) else key)
    pick = F.min_by(F.struct(*rows.columns), F.struct(*order))
    return keyed.groupBy("_key").agg(pick.alias("_r")).select("_r.*")


def download_cost(vertices: DataFrame, tiles: DataFrame, packs: DataFrame, padding_m: float = 4500.0,
                  grid=DEFAULT_GRID, size_m: float = 5000.0) -> DataFrame:
    """Per route: tiles in the padded square, missing ones, packs and bytes."""
    radius = math.ceil(padding_m / size_m)
    tx, ty = tile_of("lat", "lng", grid, size_m)
    base = vertices.select("route_id", tx.alias("bx"), ty.alias("by")).distinct()
    shift = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"))
                      for i in range(-radius, radius + 1) for j in range(-radius, radius + 1)])
    need = base.withColumn("_s", F.explode(shift)).select(
        "route_id", (F.col("bx") + F.col("_s.i")).alias("tx"), (F.col("by") + F.col("_s.j")).alias("ty")).distinct()
    found = need.join(tiles.select("tx", "ty", "pack"), ["tx", "ty"], "left")
    counts = found.groupBy("route_id").agg(F.count(F.lit(1)).alias("tile_count"),
                                           F.count_if(F.col("pack").isNull()).alias("missing_tiles"))
    cost = found.filter("pack IS NOT NULL").select("route_id", "pack").distinct().join(
        packs.select("pack", "bytes"), "pack").groupBy("route_id").agg(
        F.count(F.lit(1)).alias("pack_count"), F.sum("bytes").alias("download_bytes"))
    n_base = base.groupBy("route_id").agg(F.count(F.lit(1)).alias("base_tiles"))
    return counts.join(n_base, "route_id").join(cost, "route_id", "left").fillna(
        0, ["pack_count", "download_bytes"])
