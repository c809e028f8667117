"""Roads, signs, countries and place candidates around positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import along, angle_between, haversine_m, lng_scale, segment_fraction, way_bearing
from ..functions.keys import country_cell
from ..functions.places import address_score, looks_like_street, normalize_country
from ..session import cut_lineage
from .spatial import explode_geo_points, explode_geo_segments, settled, spread

ROAD_M, STOP_M, BOOTH_M = 45.0, 45.0, 90.0
NAME_BONUS = 80.0
PLACE_BOX_DEG = 0.0005


def _plain(value) -> Column:
    return F.lower(F.trim(F.coalesce(value, F.lit(""))))


def best_road(fixes: DataFrame, roads: DataFrame, within_m: float = ROAD_M) -> DataFrame:
    """Best road within 45 m: distance + 2 x bearing difference - 80 for the name.

    ``fixes``: fix_id, lat, lng, heading (NULL = unknown), road_name. ``roads``:
    way_id, line, name, and tag columns, which ride along. A road's bearing and
    name part is the same on all its segments, so one aggregate over the nearby
    segments decides; ties go to the lower way id.
    """
    tags = [c for c in roads.columns if c not in ("way_id", "line")]
    ways = roads.filter(F.size("line") >= 2).withColumn("_bearing", way_bearing("line"))
    parts = ways.withColumn("_i", F.explode(F.sequence(F.lit(1), F.size("line") - 1)))
    a, b = F.element_at("line", F.col("_i")), F.element_at("line", F.col("_i") + 1)
    parts = parts.select("way_id", *tags, "_bearing", a["lat"].alias("lat1"), a["lng"].alias("lng1"),
                         b["lat"].alias("lat2"), b["lng"].alias("lng2"))
    parts = explode_geo_segments(parts, within_m)
    ready = spread(fixes.select("fix_id", "lat", "lng", "heading", _plain(F.col("road_name")).alias("_want"),
                                lng_scale("lat").alias("_kx")), "fix_id")
    near = explode_geo_points(ready, "lat", "lng", within_m)
    # The planner takes expanded rows for as few as their table has and would send them to the driver.
    pairs = settled(near.hint("merge").join(parts, ["band", "cx", "cy"]), "_t",
                    segment_fraction("lat", "lng", "lat1", "lng1", "lat2", "lng2", "_kx"))
    pairs = settled(pairs, "_m", haversine_m("lat", "lng", along("lat1", "lat2", "_t"), along("lng1", "lng2", "_t"))).filter(
        F.col("_m") <= within_m)
    want, have = F.col("_want"), _plain(F.col("name"))
    named = (want != "") & (have != "") & ((F.instr(want, have) > 0) | (F.instr(have, want) > 0))
    score = F.col("_m") + F.coalesce(angle_between("_bearing", "heading") * 2.0, F.lit(0.0)) - F.when(
        named, NAME_BONUS).otherwise(0.0)
    pairs = pairs.withColumn("_score", score)
    best = pairs.groupBy("fix_id").agg(F.min_by(F.struct("way_id", *tags), F.struct("_score", "way_id")).alias("_b"),
                                       F.min("_score").alias("match_score"))
    return best.select("fix_id", "_b.*", "match_score")


def near_points(fixes: DataFrame, signs: DataFrame, within_m: float, out: str) -> DataFrame:
    """fix_id with a flag that some sign lies within ``within_m``."""
    near = explode_geo_points(spread(fixes.select("fix_id", "lat", "lng"), "fix_id"), "lat", "lng", within_m)
    at = explode_geo_points(signs.select(F.col("lat").alias("_lat"), F.col("lng").alias("_lng")), "_lat", "_lng",
                            within_m, around=False)
    hit = near.join(at, ["band", "cx", "cy"]).filter(haversine_m("lat", "lng", "_lat", "_lng") <= within_m)
    hit = hit.select("fix_id").distinct().withColumn(out, F.lit(True))
    return fixes.select("fix_id").join(hit, "fix_id", "left").withColumn(out, F.coalesce(out, F.lit(False)))


def country_by_cell(positions: DataFrame, lookups: DataFrame) -> DataFrame:
    """Explicit code, else the code known for the position's cell, else NULL.

    ``positions``: id columns, lat, lng, country_code. ``lookups``: cell, code.
    """
    known = lookups.groupBy("cell").agg(F.max(normalize_country("code")).alias("_code"))
    given = normalize_country("country_code")
    out = positions.withColumn("cell", country_cell("lat", "lng")).join(known, "cell", "left")
    return out.withColumn("country", F.coalesce(F.nullif(given, F.lit("")), F.nullif(F.col("_code"), F.lit("")))).drop("_code")


def cells_to_look_up(positions: DataFrame) -> DataFrame:
    """One lookup per cell of about 110 m."""
    return positions.select(country_cell("lat", "lng").alias("cell")).distinct()


def rank_places(results: DataFrame, top: int = 7) -> DataFrame:
    """The seven best candidates of each query.

    ``results``: query_id, query, result_id, source, display_name, short_title,
    house_number, road, importance, dist_km. Street addresses rank by provider,
    then by match score (to 3 decimals), then by distance; other queries by
    distance alone.
    """
    street = looks_like_street("query")
    score = F.round(address_score("query", ["short_title", "display_name", "house_number", "road"],
                                  "house_number", "importance"), 3)
    rows = results.withColumn("match_score", F.when(street, score)).withColumn(
        "_first", F.when(street & (F.col("source") == "nominatim"), 0).otherwise(1))
    w = Window.partitionBy("query_id").orderBy(
        "_first", F.desc_nulls_last("match_score"), F.asc_nulls_last("dist_km"), "result_id")
    return rows.withColumn("place_rank", F.row_number().over(w)).filter(F.col("place_rank") <= top).drop("_first")


def nearest_place(places: DataFrame, key: str = "query_id") -> DataFrame:
    best = F.min_by(F.struct("result_id", "dist_km"), F.struct("dist_km", "result_id"))
    return places.groupBy(key).agg(best.alias("_b")).select(key, "_b.*")


def merge_place_results(results: DataFrame) -> DataFrame:
    """Provider union where a result within 0.0005 degrees repeats a kept one.

    Results come in ``order_no``. A repeat is dropped, or replaces the kept one
    in place when the query is a street address and its match is better. Only
    results in touching boxes influence each other, so the ordered rule runs per
    (query, cluster of touching cells); clusters spread over the tasks however
    many results a query has.
    """
    import pandas as pd

    score = address_score("query", ["short_title", "display_name", "house_number", "road"], "house_number", "importance")
    rows = results.filter(F.col("lat").isNotNull() & F.col("lng").isNotNull()).withColumns({
        "_cx": F.floor(F.col("lng") / PLACE_BOX_DEG), "_cy": F.floor(F.col("lat") / PLACE_BOX_DEG),
        "_score": score, "_street": looks_like_street("query")})
    clusters = touching_cells(rows.select("query_id", "_cx", "_cy").distinct())
    rows = rows.join(clusters, ["query_id", "_cx", "_cy"])

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("order_no", kind="stable")
        lat, lng, score = (pdf[c].to_numpy() for c in ("lat", "lng", "_score"))
        street = bool(pdf["_street"].iloc[0])
        kept: list[int] = []
        for i in range(len(pdf)):
            for slot, j in enumerate(kept):
                if abs(lat[j] - lat[i]) < PLACE_BOX_DEG and abs(lng[j] - lng[i]) < PLACE_BOX_DEG:
                    if street and score[i] > score[j]:
                        kept[slot] = i
                    break
            else:
                kept.append(i)
        return pdf.iloc[kept][["query_id", "result_id"]]

    kept = rows.select("query_id", "result_id", "order_no", "lat", "lng", "_score", "_street", "cluster").groupBy(
        "query_id", "cluster").applyInPandas(merge, "query_id long, result_id long")
    return results.join(kept, ["query_id", "result_id"], "left_semi")


def touching_cells(cells: DataFrame) -> DataFrame:
    """Label connected cells of each query by their smallest member.

    Labels spread between the eight neighbours in checkpointed rounds; each
    round also jumps to the label's own label, which halves long chains.
    """
    name = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    state = cut_lineage(cells.withColumn("cluster", name(F.col("_cx"), F.col("_cy"))))
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"))
                       for i in (-1, 0, 1) for j in (-1, 0, 1)])
    while True:
        sent = state.withColumn("_s", F.explode(around)).select(
            "query_id", (F.col("_cx") + F.col("_s.i")).alias("_cx"), (F.col("_cy") + F.col("_s.j")).alias("_cy"), "cluster")
        least = sent.groupBy("query_id", "_cx", "_cy").agg(F.min("cluster").alias("_new"))
        moved = state.join(least, ["query_id", "_cx", "_cy"])
        owner = state.select("query_id", F.col("_cx").alias("_ox"), F.col("_cy").alias("_oy"), F.col("cluster").alias("_up"))
        moved = moved.withColumns({"_ox": F.col("_new.x"), "_oy": F.col("_new.y")}).join(
            owner, ["query_id", "_ox", "_oy"], "left")
        moved = cut_lineage(moved.select("query_id", "_cx", "_cy", "cluster", F.least("_new", F.coalesce("_up", "_new")).alias("_next")))
        if moved.filter(F.col("cluster") != F.col("_next")).isEmpty():
            return moved.select("query_id", "_cx", "_cy", "cluster")
        state = moved.select("query_id", "_cx", "_cy", F.col("_next").alias("cluster"))


def recent_destinations(visits: DataFrame, removed: DataFrame | None = None, keep: int = 8) -> DataFrame:
    """Newest visit per (user, name), then the last eight names of each user.

    ``removed`` are tombstones: user_id, name, removed_ms; later visits return.
    """
    newest = visits.groupBy("user_id", "name").agg(F.max(F.struct("visit_ms", "visit_id")).alias("_v")).select(
        "user_id", "name", "_v.*")
    if removed is not None:
        gone = removed.groupBy("user_id", "name").agg(F.max("removed_ms").alias("_r"))
        newest = newest.join(gone, ["user_id", "name"], "left").filter(
            F.col("_r").isNull() | (F.col("visit_ms") > F.col("_r"))).drop("_r")
    w = Window.partitionBy("user_id").orderBy(F.desc("visit_ms"), F.desc("visit_id"))
    return newest.withColumn("place_no", F.row_number().over(w)).filter(F.col("place_no") <= keep)


def last_entries(log: DataFrame, keep: int = 500, key: str = "session_id") -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc("entry_ms"), F.desc("entry_id"))
    return log.withColumn("entry_no", F.row_number().over(w)).filter(F.col("entry_no") <= keep)
