"""Where a car should stop: the last named road instead of an unnamed access way."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import haversine_m

NEAR_M = 300.0


def _end(step: Column) -> Column:
    return F.element_at(step["geometry"]["coordinates"], -1)


def trim_to_road(routes: DataFrame) -> DataFrame:
    """Cut a short unnamed tail off the last leg of each landed route.

    The last named step is used when unnamed driving follows it and its end lies
    within 300 m of the snapped waypoint; otherwise the waypoint stands. The
    geometry ends at the vertex nearest to that point, the later one on ties,
    and the tail's distance and duration are taken off. One row per route: the
    arrays are those of the landed document.
    """
    last_leg = F.element_at("legs", -1)
    steps = F.coalesce(last_leg["steps"], F.array().cast(routes.schema["legs"].dataType.elementType["steps"].dataType))
    driving = F.filter(steps, lambda s: s["maneuver"].isNotNull() & (s["maneuver"]["type"] != "arrive"))
    named = lambda s: (F.trim(F.coalesce(s["name"], F.lit(""))) != "") & (F.size(s["geometry"]["coordinates"]) > 0)
    out = routes.withColumn("_driving", driving)
    indexed = F.transform("_driving", lambda s, i: F.when(named(s), i))
    out = out.withColumn("_named", F.array_max(indexed))
    step = F.get("_driving", F.col("_named"))
    tail = F.slice("_driving", F.col("_named") + 2, F.greatest(F.lit(0), F.size("_driving") - F.col("_named") - 1))
    snapped = F.element_at("waypoints", -1)["location"]
    out = out.withColumns({"_at": _end(step), "_tail": tail, "_snap": snapped})
    unnamed = F.exists("_tail", lambda s: F.trim(F.coalesce(s["name"], F.lit(""))) == "")
    gap = haversine_m(F.col("_at")[1], F.col("_at")[0], F.col("_snap")[1], F.col("_snap")[0])
    out = out.withColumn("trimmed", F.coalesce(unnamed & (gap <= NEAR_M), F.lit(False)))
    total = lambda field: F.aggregate("_tail", F.lit(0.0), lambda a, s: a + F.coalesce(s[field], F.lit(0.0)))
    line = F.col("geometry.coordinates")
    far = F.transform(line, lambda p, i: F.struct(haversine_m(F.col("_at")[1], F.col("_at")[0], p[1], p[0]).alias("m"), (-i).alias("i"), p.alias("p")))
    out = out.withColumn("_near", F.array_min(far))
    kept = F.slice(line, 1, 1 - F.col("_near.i"))
    kept = F.when(F.col("_near.m") > 1, F.concat(kept, F.array("_at"))).otherwise(kept)
    cut = F.col("trimmed")
    out = out.withColumns({
        "distance": F.when(cut, F.greatest(F.lit(0.0), F.col("distance") - total("distance"))).otherwise(F.col("distance")),
        "duration": F.when(cut, F.greatest(F.lit(0.0), F.col("duration") - total("duration"))).otherwise(F.col("duration")),
        "geometry": F.struct(F.when(cut, kept).otherwise(line).alias("coordinates")),
        "destination": F.when(cut, F.col("_at")).otherwise(F.coalesce("_snap", "_at", F.element_at(line, -1)))})
    return out.drop("_driving", "_named", "_at", "_tail", "_snap", "_near")
