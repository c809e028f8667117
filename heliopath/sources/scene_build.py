"""From map ways and elevation lines to building, tunnel and terrain tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import RAD, tile_of, unproject
from ..functions.osm import HEIGHT_COLUMNS, with_height_model

GRID = (38.0, -81.0, math.cos(43.0 * RAD))
TILE_M = 5000.0
LATTICE_M = 100.0
DEM_STEPS = 3600
TERRAIN_ERROR_M = 10.0


def way_points(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Way references with their coordinates; references to absent nodes go."""
    return refs.join(nodes.select("node_id", "lat", "lng"), "node_id").select(
        *[c for c in refs.columns], "lat", "lng")


def way_shapes(points: DataFrame, kind: str = "way_kind") -> DataFrame:
    """One row per way: ordered polyline, vertex mean, bounds, point count.

    Mean, bounds and count combine before the shuffle. Ways with too few points
    for their kind (3 for buildings, 2 otherwise) are dropped.
    """
    from ..functions.osm import min_points

    ordered = F.sort_array(F.collect_list(F.struct("pos", "lat", "lng")))
    out = points.groupBy("way_id", kind).agg(
        F.transform(ordered, lambda p: F.struct(p["lat"].alias("lat"), p["lng"].alias("lng"))).alias("line"),
        F.count(F.lit(1)).alias("n_points"), F.avg("lat").alias("center_lat"), F.avg("lng").alias("center_lng"),
        F.min("lat").alias("south"), F.max("lat").alias("north"), F.min("lng").alias("west"), F.max("lng").alias("east"))
    return out.filter(F.col("n_points") >= min_points(kind))


def with_tile(rows: DataFrame, lat: str = "center_lat", lng: str = "center_lng", grid=GRID) -> DataFrame:
    tx, ty = tile_of(lat, lng, grid, TILE_M)
    return rows.withColumn("tx", tx).withColumn("ty", ty)


def scene_tile_keys(points: DataFrame, grid=GRID) -> DataFrame:
    """Distinct tiles touched by any way point."""
    return with_tile(points, "lat", "lng", grid).select("tx", "ty").distinct()


def dem_cell(lat, lng) -> tuple[Column, Column, Column, Column]:
    """(north, west, row, col) of the elevation cell of a coordinate."""
    lat, lng = (F.col(v) if isinstance(v, str) else v for v in (lat, lng))
    north, west = F.floor(lat), F.floor(lng)
    clip = lambda v: F.least(F.lit(DEM_STEPS), F.greatest(F.lit(0), F.floor(v + 0.5))).cast("int")
    return (north.cast("int"), west.cast("int"), clip((north + 1 - lat) * DEM_STEPS), clip((lng - west) * DEM_STEPS))


def with_elevation(rows: DataFrame, dem_lines: DataFrame, lat: str, lng: str, out: str = "ground") -> DataFrame:
    """Elevation of the raster cell; NULL without a raster or for a void.

    ``dem_lines``: north, west, row, elev array. A row of the raster is the join
    unit, so the shuffle carries whole lines and not single cells.
    """
    north, west, row, column = dem_cell(lat, lng)
    keyed = rows.withColumns({"_n": north, "_w": west, "_r": row, "_col": column})
    lines = dem_lines.select(F.col("north").alias("_n"), F.col("west").alias("_w"), F.col("row").alias("_r"), "elev")
    hit = keyed.join(lines, ["_n", "_w", "_r"], "left")
    return hit.withColumn(out, F.get("elev", F.col("_col")).cast("double")).drop("_n", "_w", "_r", "_col", "elev")


def lattice(tiles: DataFrame, grid=GRID, spacing_m: float = LATTICE_M) -> DataFrame:
    """Points every 100 m of each tile, both edges included: 51 x 51."""
    n = int(TILE_M // spacing_m)
    steps = F.sequence(F.lit(0), F.lit(n))
    grid_points = tiles.select("tx", "ty", F.explode(steps).alias("iy")).withColumn("ix", F.explode(steps))
    lat, lng = unproject(F.col("tx") * TILE_M + F.col("ix") * spacing_m, F.col("ty") * TILE_M + F.col("iy") * spacing_m, *grid)
    return grid_points.select("tx", "ty", "ix", "iy", F.round(lat, 6).alias("lat"), F.round(lng, 6).alias("lng"))


def terrain_table(tiles: DataFrame, dem_lines: DataFrame, grid=GRID) -> DataFrame:
    found = with_elevation(lattice(tiles, grid), dem_lines, "lat", "lng", "elevation")
    return found.filter(F.col("elevation").isNotNull()).withColumn(
        "elevation", F.floor(F.col("elevation") + 0.5))


def building_table(shapes: DataFrame, tags: DataFrame, dem_lines: DataFrame, grid=GRID) -> DataFrame:
    """Buildings with height envelope, tile and ground elevation of the centre.

    ``tags``: way_id, tag_height, tag_levels, tag_min_height, tag_min_level.
    """
    rows = shapes.filter(F.col("way_kind") == "building").join(tags, "way_id", "left")
    rows = with_height_model(rows, "tag_height", "tag_levels", "tag_min_height", "tag_min_level")
    rows = with_elevation(with_tile(rows, grid=grid), dem_lines, "center_lat", "center_lng")
    return rows.select("tx", "ty", F.concat(F.lit("way/"), F.col("way_id").cast("string")).alias("id"),
                       F.col("line").alias("polygon"), "center_lat", "center_lng", *HEIGHT_COLUMNS, "ground",
                       F.lit(TERRAIN_ERROR_M).alias("ground_error_m"))


def tunnel_table(shapes: DataFrame, grid=GRID) -> DataFrame:
    rows = with_tile(shapes.filter(F.col("way_kind").isin("tunnel", "covered")), grid=grid)
    return rows.select("tx", "ty", F.concat(F.lit("way/"), F.col("way_id").cast("string")).alias("id"), "line")


def tile_stats(tiles: DataFrame, buildings: DataFrame, tunnels: DataFrame, terrain: DataFrame) -> DataFrame:
    """Counts per tile and whether every building's ground is known."""
    b = buildings.groupBy("tx", "ty").agg(F.count(F.lit(1)).alias("buildings"),
                                          F.bool_and(F.col("ground").isNotNull()).alias("building_ground"))
    t = tunnels.groupBy("tx", "ty").agg(F.count(F.lit(1)).alias("tunnels"))
    e = terrain.groupBy("tx", "ty").agg(F.count(F.lit(1)).alias("terrain"))
    out = tiles.join(b, ["tx", "ty"], "left").join(t, ["tx", "ty"], "left").join(e, ["tx", "ty"], "left")
    return out.fillna(0, ["buildings", "tunnels", "terrain"]).fillna(True, ["building_ground"])


def normalize_scene_buildings(rows: DataFrame, default_error_m: float = 2.0) -> DataFrame:
    """Older tile rows get the defaults of the newer schema.

    ``rows``: schema, id, height and the optional envelope columns. Versions
    other than 2 and 3 belong into quarantine; see ``supported_schema``.
    """
    h = F.when(F.col("height") != 0, F.col("height"))
    h = F.coalesce(h, F.lit(6.0))
    legacy = F.when(F.coalesce("height_estimated", F.lit(False)), "legacy-estimated").otherwise("legacy-height")
    return rows.withColumns({
        "height": h, "height_lower": F.coalesce("height_lower", h), "height_upper": F.coalesce("height_upper", h),
        "height_source": F.coalesce("height_source", legacy),
        "min_height": F.coalesce("min_height", F.lit(0.0)),
        "min_height_lower": F.coalesce("min_height_lower", F.lit(0.0)),
        "min_height_upper": F.coalesce("min_height_upper", F.lit(0.0)),
        "ground_error_m": F.coalesce("ground_error_m", F.lit(default_error_m))})


def supported_schema(version) -> Column:
    return F.coalesce((F.col(version) if isinstance(version, str) else version).isin(2, 3), F.lit(False))


def pending_tiles(wanted: DataFrame, written: DataFrame) -> DataFrame:
    """Resume: tiles whose key and metadata fingerprint are not written yet."""
    return wanted.join(written.select("tx", "ty", "fingerprint"), ["tx", "ty", "fingerprint"], "left_anti")


def fingerprint(*parts) -> Column:
    """Hash of everything a reused tile must agree on."""
    texts = [F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts]
    return F.sha2(F.concat_ws("|", *texts), 256)


def write_tiles(df: DataFrame, path: str) -> None:
    """Partitioned by tile; a rerun replaces only the tiles it holds."""
    (df.repartition("tx", "ty").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("tx", "ty").parquet(path))


def write_staging(df: DataFrame, path: str) -> None:
    df.repartition("tx", "ty").write.mode("overwrite").partitionBy("tx", "ty").json(path)
