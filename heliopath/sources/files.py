"""Readers of landed files: routes, elements, elevation rasters, assets; sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

STEP = ("struct<distance:double,duration:double,name:string,ref:string,toll:boolean,tunnel:string,"
        "classes:array<string>,intersections:array<struct<classes:array<string>>>,"
        "maneuver:struct<type:string,modifier:string,location:array<double>,bearing_before:double,"
        "bearing_after:double>,geometry:struct<coordinates:array<array<double>>>>")
LEG = f"struct<distance:double,duration:double,steps:array<{STEP}>>"
ROUTE = f"struct<distance:double,duration:double,geometry:struct<coordinates:array<array<double>>>,legs:array<{LEG}>>"
ROUTES = f"struct<routes:array<{ROUTE}>,waypoints:array<struct<location:array<double>>>>"
ELEMENTS = ("struct<elements:array<struct<type:string,id:bigint,lat:double,lon:double,tags:map<string,string>,"
            "geometry:array<struct<lat:double,lon:double>>>>>")
GPS_FIX = ("session_id bigint, fix_id bigint, fix_ms bigint, lat double, lng double, accuracy double, "
           "reported_speed_kmh double, hw_heading double, source string")


def route_candidates(responses: DataFrame, column: str = "response", od: str = "od_id") -> DataFrame:
    """One row per route of a landed routing response.

    The plain explode would make the planner test the parsed routes for being empty first, which parses each text twice more.
    """
    parsed = responses.withColumn("_r", F.from_json(column, ROUTES))
    rows = parsed.select(od, F.col("_r.waypoints").alias("waypoints"),
                         F.posexplode_outer("_r.routes").alias("candidate_index", "route")).filter(F.col("candidate_index").isNotNull())
    return rows.select(od, F.col("candidate_index").cast("long").alias("candidate_index"), "route.*", "waypoints")


def route_vertices(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Usable coordinates in order, renumbered densely; input pairs are (lng, lat)."""
    usable = F.filter("geometry.coordinates", lambda p: (F.size(p) >= 2) & p[0].isNotNull() & p[1].isNotNull())
    return candidates.select(*keys, F.posexplode(usable).alias("v_idx", "_p")).select(
        *keys, F.col("v_idx").cast("long").alias("v_idx"), F.col("_p")[1].alias("lat"), F.col("_p")[0].alias("lng"))


def route_steps(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """All steps of all legs in driving order, numbered densely."""
    steps = F.flatten(F.transform("legs", lambda leg: F.coalesce(leg["steps"], F.array().cast(f"array<{STEP}>"))))
    return candidates.select(*keys, F.posexplode(steps).alias("step_idx", "step")).select(
        *keys, F.col("step_idx").cast("long").alias("step_idx"), "step.*")


def _lower_has(values, word: str) -> Column:
    return F.exists(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.lower(v).contains(word))


def step_classes() -> Column:
    inner = F.flatten(F.transform(F.coalesce("intersections", F.array().cast("array<struct<classes:array<string>>>")),
                                  lambda i: F.coalesce(i["classes"], F.array().cast("array<string>"))))
    return F.concat(F.coalesce("classes", F.array().cast("array<string>")), inner)


def step_is_tunnel() -> Column:
    flag = F.lower(F.coalesce("tunnel", F.lit(""))).isin("yes", "true")
    return flag | _lower_has(step_classes(), "tunnel")


def step_has_toll() -> Column:
    return F.coalesce(F.col("toll"), F.lit(False)) | F.coalesce(
        F.array_contains(step_classes(), "toll"), F.lit(False))


def route_has_toll(legs: str = "legs") -> Column:
    """Any toll step, toll class or toll intersection."""
    none = F.array().cast("array<string>")
    marked = lambda s: (F.coalesce(s["toll"], F.lit(False)) | F.array_contains(F.coalesce(s["classes"], none), "toll")
                        | F.exists(F.coalesce(s["intersections"], F.array().cast("array<struct<classes:array<string>>>")),
                                   lambda i: F.array_contains(F.coalesce(i["classes"], none), "toll")))
    steps = lambda leg: F.coalesce(leg["steps"], F.array().cast(f"array<{STEP}>"))
    return F.coalesce(F.exists(legs, lambda leg: F.exists(steps(leg), marked)), F.lit(False))


def maneuvers(steps: DataFrame, key: str = "route_id") -> DataFrame:
    """Steps with a maneuver other than departing, and the distance before them.

    The steps of a key come out of one landed document, so they fit a task, and the texts are parsed once.
    """
    w = Window.partitionBy(key).orderBy("step_idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    m = F.coalesce("distance", F.lit(0.0))
    summed = steps.withColumn("cumulative_m", F.sum(m).over(w) - m)
    kept = summed.filter(F.col("maneuver").isNotNull() & (F.coalesce("maneuver.type", F.lit("")) != "depart"))
    return kept.select(
        key, "step_idx", F.col("maneuver.type").alias("type"),
        F.coalesce("maneuver.modifier", F.lit("")).alias("modifier"),
        F.get("maneuver.location", F.lit(1)).alias("lat"), F.get("maneuver.location", F.lit(0)).alias("lng"),
        F.col("maneuver.bearing_before").alias("bearing_before"), F.col("maneuver.bearing_after").alias("bearing_after"),
        F.coalesce("name", F.lit("")).alias("name"), F.coalesce("ref", F.lit("")).alias("ref"),
        "distance", "duration", "cumulative_m")


def any_route_coordinates(text) -> Column:
    """(lng, lat) pairs of an array, a value list, GeoJSON or a routing response."""
    t = F.col(text) if isinstance(text, str) else text
    point = "array<array<double>>"
    listed = F.from_json(t, "array<struct<value:array<double>>>")
    values = F.when(F.size(F.filter(listed, lambda v: v["value"].isNotNull())) > 0, F.transform(listed, lambda v: v["value"]))
    line = F.from_json(t, f"struct<type:string,coordinates:{point}>")
    feature = F.from_json(t, f"struct<type:string,geometry:struct<coordinates:{point}>>")
    routed = F.from_json(t, f"struct<routes:array<struct<geometry:struct<coordinates:{point}>>>>")
    return (F.when(t.rlike(r"^\s*\[\s*(\[|\])"), F.from_json(t, point)).when(t.rlike(r"^\s*\["), values)
            .when(feature["type"] == "Feature", feature["geometry"]["coordinates"])
            .when(line["type"] == "LineString", line["coordinates"])
            .otherwise(F.get(routed["routes"], F.lit(0))["geometry"]["coordinates"]))


def manifest_tiles(text) -> Column:
    """(key, file, pack, bytes, sha256) of the tiles of a manifest, array or map."""
    t = F.col(text) if isinstance(text, str) else text
    entry = "key:string,path:string,file:string,pack:string,bytes:bigint,sha256:string"
    listed = F.from_json(t, f"struct<tiles:array<struct<{entry}>>>")["tiles"]
    mapped = F.from_json(t, f"struct<tiles:map<string,struct<{entry}>>>")["tiles"]

    def row(key, tile, first, second) -> Column:
        return F.struct(key.alias("key"), F.coalesce(tile[first], tile[second]).alias("file"), tile["pack"].alias("pack"),
                        tile["bytes"].alias("bytes"), tile["sha256"].alias("sha256"))

    is_array = t.rlike(r'"tiles"\s*:\s*\[')
    return F.when(is_array, F.transform(listed, lambda x: row(x["key"], x, "path", "file"))).otherwise(
        F.transform(F.map_entries(mapped), lambda e: row(e["key"], e["value"], "file", "path")))


def map_elements(responses: DataFrame, column: str = "response", keep: list[str] | None = None) -> DataFrame:
    """Elements of a landed map query: type, id, tags, geometry and position."""
    parsed = responses.select(*(keep or []), F.posexplode(F.from_json(column, ELEMENTS)["elements"]).alias("pos", "e"))
    return parsed.select(*(keep or []), "pos", "e.*")


def element_points() -> Column:
    return F.filter("geometry", lambda p: p["lat"].isNotNull() & p["lon"].isNotNull())


def buildings_of(elements: DataFrame, order: list[str]) -> DataFrame:
    """Building elements with a height envelope; the first copy of an id wins."""
    from ..functions.osm import HEIGHT_COLUMNS, with_height_model
    from ..operators.tiles import first_of_each

    tag = F.coalesce(F.col("tags")["building"], F.col("tags")["building:part"])
    rows = elements.withColumn("points", element_points()).filter(tag.isNotNull() & (F.size("points") >= 3))
    key = F.coalesce(F.col("id").cast("string"), F.to_json("points"))
    rows = first_of_each(rows.withColumn("building", tag), key, order)
    t = F.col("tags")
    rows = with_height_model(rows, t["height"], t["building:levels"], t["min_height"], t["building:min_level"])
    return rows.select("id", "building", "points", *HEIGHT_COLUMNS)


def tunnels_of(elements: DataFrame, order: list[str]) -> DataFrame:
    from ..functions.osm import is_tunnel_way
    from ..operators.tiles import first_of_each

    rows = elements.withColumn("points", element_points()).filter(is_tunnel_way("tags") & (F.size("points") >= 2))
    key = F.coalesce(F.col("id").cast("string"), F.to_json("points"))
    return first_of_each(rows, key, order).select("id", "points")


def elevation_answers(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Answers belong to requests by position within their batch.

    ``requests``: batch_id, pos, key. ``responses``: batch_id, response.
    """
    parsed = responses.select("batch_id", F.posexplode(F.from_json(
        "response", "struct<results:array<struct<elevation:double>>>")["results"]).alias("pos", "r"))
    return requests.join(parsed, ["batch_id", "pos"], "left").select(
        "batch_id", "pos", "key", F.col("r.elevation").alias("elevation"))


def place_results(text, provider) -> Column:
    """Array of one place schema from either provider's response text."""
    t = F.col(text) if isinstance(text, str) else text
    nom = F.from_json(t, "array<struct<lat:string,lon:string,display_name:string,name:string,importance:double,"
                         "address:struct<house_number:string,road:string>>>")
    pho = F.from_json(t, "struct<features:array<struct<properties:struct<name:string,street:string,city:string,"
                         "town:string,district:string,state:string,country:string,housenumber:string,"
                         "importance:double>,geometry:struct<coordinates:array<double>>>>>")["features"]
    some = lambda c: F.nullif(F.coalesce(c, F.lit("")), F.lit(""))
    blank = lambda c: F.coalesce(c, F.lit(""))

    def row(display, title, lat, lng, source, house, road, importance) -> Column:
        return F.struct(display.alias("display_name"), title.alias("short_title"), lat.alias("lat"), lng.alias("lng"),
                        F.lit(source).alias("source"), blank(house).alias("house_number"), blank(road).alias("road"),
                        F.coalesce(importance, F.lit(0.0)).alias("importance"))

    def nominatim(x: Column) -> Column:
        label = F.concat_ws(" ", some(x["address"]["house_number"]), some(x["address"]["road"]))
        name = F.trim(blank(x["display_name"]))
        title = F.coalesce(some(label), some(x["name"]), F.split(name, ",")[0])
        return row(name, title, x["lat"].try_cast("double"), x["lon"].try_cast("double"), "nominatim",
                   x["address"]["house_number"], x["address"]["road"], x["importance"])

    def photon(x: Column) -> Column:
        p = x["properties"]
        town = F.coalesce(some(p["city"]), some(p["town"]), some(p["district"]))
        parts = F.array_compact(F.array(some(p["name"]), some(p["street"]), town, some(p["state"]), some(p["country"])))
        xy = x["geometry"]["coordinates"]
        return row(F.array_join(parts, ", "), F.coalesce(some(p["name"]), F.get(parts, F.lit(0))), F.get(xy, F.lit(1)),
                   F.get(xy, F.lit(0)), "photon", p["housenumber"], p["street"], p["importance"])

    rows = F.when((F.col(provider) if isinstance(provider, str) else provider) == "nominatim",
                  F.transform(nom, nominatim)).otherwise(F.transform(pho, photon))
    return F.filter(rows, lambda r: (r["display_name"] != "") & r["lat"].isNotNull() & r["lng"].isNotNull())


def region_bounds(lines: DataFrame, key: str = "region", column: str = "value") -> DataFrame:
    """Bounds of the coordinate lines of a polygon text file."""
    pattern = r"^(-?\d+(?:\.\d+)?(?:[Ee][+-]?\d+)?)\s+(-?\d+(?:\.\d+)?(?:[Ee][+-]?\d+)?)"
    text = F.trim(F.col(column))
    part = lambda i: F.nullif(F.regexp_extract(text, pattern, i), F.lit("")).try_cast("double")
    points = lines.select(key, part(1).alias("lng"), part(2).alias("lat")).filter(
        (F.abs("lat") <= 90) & (F.abs("lng") <= 180))
    return points.groupBy(key).agg(F.min("lat").alias("south"), F.min("lng").alias("west"),
                                   F.max("lat").alias("north"), F.max("lng").alias("east"))


def read_elevation_lines(spark: SparkSession, path: str, side: int = 3601) -> DataFrame:
    """Raster files as one row per line: file, north, west, row, elev, problem.

    Names such as N42W072.hgt (also gzipped) hold the south-west corner; values
    are big-endian 16-bit, -32768 is void. One file is one row of the scan, so
    files spread over the tasks. A file that cannot be read gives one row that
    holds nothing but its name and the ``problem``.
    """
    import gzip
    import re
    import zlib

    import numpy as np
    import pyarrow as pa

    kinds = pa.schema([("file", pa.string()), ("north", pa.int32()), ("west", pa.int32()), ("row", pa.int32()),
                       ("elev", pa.list_(pa.int16())), ("problem", pa.string())])

    def lines(name, content):
        found = re.search(r"([NS])(\d{2})([EW])(\d{3})\.hgt(?:\.gz)?$", name)
        file, problem, raw = name.rsplit("/", 1)[-1], None if found else "FILE_NAME", content
        if name.endswith(".gz"):
            try:
                raw = gzip.decompress(content)
            except (OSError, EOFError, zlib.error):
                problem = problem or "GZIP"
        if problem is None and len(raw) != side * side * 2:
            problem = "FILE_SIZE"
        if problem:
            yield pa.RecordBatch.from_pylist([{"file": file, "problem": problem}], schema=kinds)
            return
        grid = np.frombuffer(raw, dtype=">i2").astype(np.int16).reshape(side, side)
        north = int(found[2]) * (1 if found[1] == "N" else -1)
        west = int(found[4]) * (1 if found[3] == "E" else -1)
        for start in range(0, side, 256):
            block = grid[start:start + 256]
            n = len(block)
            values = pa.array(block.ravel(), pa.int16(), mask=block.ravel() == -32768)
            elev = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * side, pa.int32()), values)
            yield pa.RecordBatch.from_arrays(
                [pa.array([file] * n), pa.array([north] * n, pa.int32()), pa.array([west] * n, pa.int32()),
                 pa.array(np.arange(start, start + n), pa.int32()), elev, pa.nulls(n, pa.string())], schema=kinds)

    def decode(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield from lines(name, content)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.hgt*").load(path)
    return files.select("path", "content").mapInArrow(
        decode, "file string, north int, west int, row int, elev array<smallint>, problem string")


def asset_checksums(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Bytes and SHA-256 of binary assets; the hash runs in the JVM."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"),
                        F.sha2("content", 256).alias("sha256"))


def source_record(assets: DataFrame, extract_time: str | None, dem_dataset: str, dem_files: int) -> DataFrame:
    """Provenance row of an extract. The local file time is never the extract time."""
    return assets.select("file", "bytes", "sha256", F.lit(extract_time).cast("string").alias("extract_time"),
                         F.lit(dem_dataset).alias("dem_dataset"), F.lit(dem_files).alias("dem_files"))


def read_fixes(spark: SparkSession, path: str, streaming: bool = True) -> DataFrame:
    reader = spark.readStream if streaming else spark.read
    return reader.schema(GPS_FIX).json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


# Phases of a result in the order in which they replace each other.
PHASES = ("heuristic", "refined")


def write_phase(rows: DataFrame, path: str, phase: str, batch: str = "0") -> None:
    """Store results of one phase; writing the same batch again replaces it."""
    if phase not in PHASES:
        raise ValueError(f"unknown phase {phase}")
    rows.write.mode("overwrite").parquet(f"{path}/analysis_phase={phase}/batch={batch}")


def phase_sink(path: str, phase: str):
    """A ``foreachBatch`` function that stores each micro-batch exactly once."""
    return lambda rows, batch_id: write_phase(rows, path, phase, str(batch_id))


def latest_phase(spark: SparkSession, path: str, key: str = "route_id") -> DataFrame:
    """One row per key: of its latest phase, there of the latest batch."""
    rows = spark.read.parquet(path)
    rank = F.array_position(F.array(*map(F.lit, PHASES)), F.col("analysis_phase"))
    names = [c for c in rows.columns if c not in (key, "batch")]
    latest = F.max_by(F.struct(*names), F.struct(rank, F.col("batch").cast("long")))
    return rows.groupBy(key).agg(latest.alias("_latest")).select(key, "_latest.*")
