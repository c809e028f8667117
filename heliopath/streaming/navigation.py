"""Fix cleaning, route following and alerts for live or recorded sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import along, angle_between, bearing_deg, distance_m, haversine_m, segment_fraction
from ..operators.spatial import explode_geo_points, explode_geo_segments, nearest_segment
from ..session import cut_lineage
from .blocks import running, with_previous
from .keyed import run_batch, run_stream
from .steps import accept_fix, follow_route, raise_alerts, refresh_rules

FIX = ["session_id", "fix_id", "fix_ms", "lat", "lng", "accuracy", "source", "reported_speed_kmh", "hw_heading"]
ACCEPTED = ("reason string, accepted boolean, speed_kmh double, heading double, moved_m double, implied_kmh double")
FOLLOWED = ("seg_idx long, seg_t double, snap_lat double, snap_lng double, snapped boolean, off_route_m double, "
            "event string")
MATCH_M = 75.0
ORDER = ["fix_ms", "fix_id"]


def clean_fixes(fixes: DataFrame) -> DataFrame:
    return run_batch(fixes.select(*FIX), accept_fix, FIX, ACCEPTED)


def clean_fix_stream(fixes: DataFrame) -> DataFrame:
    return run_stream(fixes.select(*FIX), accept_fix, FIX, ACCEPTED)


def nearby_segments(segments: DataFrame, radius: float = MATCH_M) -> DataFrame:
    """Static look-up: the segments around each world-grid cell of a route.

    Each segment is listed in the cells it passes and their neighbours, so a fix
    needs one equi-join on its own cell and no aggregation.
    """
    passed = explode_geo_segments(segments.select("route_id", "seg_idx", "lat1", "lng1", "lat2", "lng2"), radius,
                                  slack_deg=radius / 111000.0)
    shift = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    spread = passed.withColumn("_s", F.explode(shift)).withColumns(
        {"cx": F.col("cx") + F.col("_s.i"), "cy": F.col("cy") + F.col("_s.j")}).drop("_s")
    return spread.groupBy("route_id", "band", "cx", "cy").agg(
        F.collect_set(F.struct("seg_idx", "lat1", "lng1", "lat2", "lng2")).alias("segments"))


def with_near(fixes: DataFrame, lookup: DataFrame, ends: DataFrame, radius: float = MATCH_M,
              segments: DataFrame | None = None) -> DataFrame:
    """Add ``near`` (segments within reach), ``goal_m`` and ``last_seg``.

    ``fixes`` carries route_id and a unique fix_id; ``ends``: route_id, end_lat,
    end_lng, last_seg. Where no segment is within reach, the nearest one of the
    route at any distance is found among ``segments``; without them (in a
    stream, which has only the look-up) ``near`` stays empty there.
    """
    rows = explode_geo_points(fixes, "lat", "lng", radius, around=False)
    rows = rows.join(lookup, ["route_id", "band", "cx", "cy"], "left").join(ends, "route_id", "left")

    def foot(s: Column) -> Column:
        t = segment_fraction("lat", "lng", s["lat1"], s["lng1"], s["lat2"], s["lng2"])
        return F.struct(s.alias("s"), t.alias("t"))

    def place(f: Column) -> Column:
        s = f["s"]
        return F.struct(s["seg_idx"].alias("seg"), f["t"].alias("t"), along(s["lat1"], s["lat2"], f["t"]).alias("lat"),
                        along(s["lng1"], s["lng2"], f["t"]).alias("lng"),
                        bearing_deg(s["lat1"], s["lng1"], s["lat2"], s["lng2"]).alias("bearing"))

    def measured(p: Column) -> Column:
        return F.struct(p["seg"].alias("seg"), p["t"].alias("t"), p["lat"].alias("lat"), p["lng"].alias("lng"),
                        haversine_m("lat", "lng", p["lat"], p["lng"]).alias("gap"), p["bearing"].alias("bearing"))

    placed = F.transform(F.transform(F.transform("segments", foot), place), measured)
    near = F.sort_array(F.filter(placed, lambda c: c["gap"] <= radius))
    out = rows.withColumn("near", near).withColumn(
        "goal_m", haversine_m("lat", "lng", "end_lat", "end_lng")).drop("segments", "band", "cx", "cy", "end_lat", "end_lng")
    if segments is None:
        return out
    out = cut_lineage(out)
    far = out.filter(F.coalesce(F.size("near"), F.lit(0)) <= 0).filter("lat IS NOT NULL AND lng IS NOT NULL")
    found = nearest_segment(far.select("fix_id", "route_id", "lat", "lng"), segments, "fix_id", first_m=8 * radius)
    only = found.select("fix_id", F.array(F.struct(
        F.col("seg_idx").alias("seg"), "t", F.col("snap_lat").alias("lat"), F.col("snap_lng").alias("lng"),
        F.col("distance").alias("gap"), bearing_deg("lat1", "lng1", "lat2", "lng2").alias("bearing"))).alias("_only"))
    return out.join(only, "fix_id", "left").withColumn("near", F.coalesce("_only", "near")).drop("_only")


def follow_routes(cleaned: DataFrame) -> DataFrame:
    """Route progress of cleaned fixes prepared by ``with_near``."""
    keep = ["session_id", "fix_id", "fix_ms", "route_id", "lat", "lng", "accepted", "speed_kmh", "heading"]
    return run_batch(cleaned.select(*keep, "near", "goal_m", "last_seg"), follow_route, keep, FOLLOWED)


def follow_route_stream(cleaned: DataFrame) -> DataFrame:
    keep = ["session_id", "fix_id", "fix_ms", "route_id", "lat", "lng", "accepted", "speed_kmh", "heading"]
    return run_stream(cleaned.select(*keep, "near", "goal_m", "last_seg"), follow_route, keep, FOLLOWED)


def next_maneuver(fixes: DataFrame, maneuvers: DataFrame, reach_m: float = 2000.0) -> DataFrame:
    """Next maneuver ahead of each fix: nearest in route order within 2 km.

    ``fixes``: fix_id, route_id, lat, lng, heading, seg_idx. ``maneuvers``:
    route_id, v_idx, lat, lng, type, modifier. Passed ones (more than two
    vertices back) and those behind (over 120 degrees, unless under 60 m) drop.
    """
    # A fix lies in one cell, four reaches wide; a maneuver is listed in the cells that come within reach.
    size, slack = 4 * reach_m, reach_m / 111000.0
    near = explode_geo_points(fixes.select("fix_id", "route_id", "lat", "lng", "heading", "seg_idx"), "lat", "lng", size,
                              around=False, slack_deg=slack)
    at = maneuvers.select("route_id", F.col("v_idx").alias("m_idx"), F.col("lat").alias("m_lat"), F.col("lng").alias("m_lng"), "type", "modifier")
    at = explode_geo_segments(at.withColumns({"lat1": F.col("m_lat"), "lng1": F.col("m_lng"), "lat2": F.col("m_lat"), "lng2": F.col("m_lng")}),
                              size, slack, margin=reach_m * 1.001).drop("lat1", "lng1", "lat2", "lng2")
    pairs = near.join(at, ["route_id", "band", "cx", "cy"]).filter(F.col("m_idx") >= F.coalesce("seg_idx", F.lit(-1)) - 2)
    pairs = pairs.withColumn("maneuver_m", haversine_m("lat", "lng", "m_lat", "m_lng")).filter(F.col("maneuver_m") < reach_m)
    side = angle_between(bearing_deg("lat", "lng", "m_lat", "m_lng"), "heading")
    pairs = pairs.filter((side < 120) | (F.col("maneuver_m") < 60))
    best = pairs.groupBy("fix_id").agg(F.min_by(
        F.struct("m_idx", "m_lat", "m_lng", "type", "modifier", "maneuver_m"),
        F.struct("m_idx", "maneuver_m")).alias("_b"))
    return best.select("fix_id", "_b.*")


def maneuver_vertices(maneuvers: DataFrame, vertices: DataFrame) -> DataFrame:
    """Route vertex nearest to each maneuver, by squared degrees, first on ties.

    ``maneuvers``: maneuver_id, route_id, lat, lng. The plane of degrees serves
    as grid; routes are kept apart.
    """
    from ..operators.spatial import nearest_any

    points = maneuvers.select("maneuver_id", "route_id", F.col("lng").alias("x"), F.col("lat").alias("y"))
    samples = vertices.select("route_id", "v_idx", F.col("lng").alias("x"), F.col("lat").alias("y"))
    return nearest_any(points, samples, "maneuver_id", "v_idx", by=["route_id"], first_m=0.002)


def turn_key(distance, lat, lng, kind, modifier) -> Column:
    """Key of a turn announcement: place, kind and distance tier; NULL if far."""
    c = lambda v: F.col(v) if isinstance(v, str) else v
    tier = F.when(c(distance) <= 50, "exec").when(c(distance) <= 150, "prep").when(c(distance) <= 400, "prev")
    place = F.format_string("%.4f_%.4f", c(lng), c(lat))
    return F.when(tier.isNotNull(), F.concat_ws("_", place, c(kind), c(modifier), tier))


def hazard_key(distance, glare) -> Column:
    c = lambda v: F.col(v) if isinstance(v, str) else v
    tier = F.when(c(distance) <= 50, "now").when(c(distance) <= 150, "near").when(c(distance) <= 350, "mid").otherwise("far")
    return F.concat_ws("_", tier, F.floor(c(glare) * 10 + 0.5).cast("string"))


def road_class(is_motorway, is_toll) -> Column:
    c = lambda v: F.coalesce(F.col(v) if isinstance(v, str) else v, F.lit(False))
    return (F.when(c(is_motorway) & c(is_toll), "toll_highway").when(c(is_motorway), "free_highway")
            .when(c(is_toll), "toll_road").otherwise("normal"))


ALERT_INPUT = ["fix_ms", "fix_id", "glare", "turn_key", "hazard_key", "speed_limit_kmh", "speed_kmh",
               "toll_booth_ahead", "road_class"]


def alerts(prepared: DataFrame) -> DataFrame:
    """One row per due alert of prepared fixes (see ``ALERT_INPUT``)."""
    rows = run_batch(prepared.select("session_id", *ALERT_INPUT), raise_alerts, ["session_id", "fix_id", "fix_ms"],
                     "alerts array<string>")
    return _alert_rows(rows)


def alert_stream(prepared: DataFrame) -> DataFrame:
    rows = run_stream(prepared.select("session_id", *ALERT_INPUT), raise_alerts, ["session_id", "fix_id", "fix_ms"],
                      "alerts array<string>")
    return _alert_rows(rows)


def _alert_rows(rows: DataFrame) -> DataFrame:
    one = rows.select("session_id", "fix_id", "fix_ms", F.explode("alerts").alias("_a"))
    return one.select("session_id", "fix_id", "fix_ms", F.split("_a", ":", 2)[0].alias("kind"),
                      F.get(F.split("_a", ":", 2), F.lit(1)).alias("detail"))


def rule_refreshes(followed: DataFrame) -> DataFrame:
    keep = ["session_id", "fix_id", "fix_ms"]
    rows = followed.select(*keep, "lat", "lng", "heading", "seg_idx", "route_id")
    return run_batch(rows, refresh_rules, keep, "refresh boolean")


def limit_after_lookup(failed, limit) -> Column:
    """A failed look-up clears the limit; the old road's is never kept."""
    return F.when(~F.col(failed), F.col(limit))


def reported_or_implied_speed(fixes: DataFrame) -> DataFrame:
    """km/h against the previous row of the session, where none was reported."""
    rows = with_previous(fixes, ["fix_ms", "lat", "lng"], "session_id", ORDER)
    seconds = (F.col("fix_ms") - F.col("prev_fix_ms")) / 1000.0
    mps = distance_m("prev_lat", "prev_lng", "lat", "lng") / seconds
    implied = F.when((seconds > 0.5) & (mps < 50), mps * 3.6).otherwise(F.lit(0.0))
    return rows.withColumn("speed_kmh", F.when(F.col("reported_speed_kmh") >= 0, F.col("reported_speed_kmh"))
                           .otherwise(F.coalesce(implied, F.lit(0.0)))).drop("prev_fix_ms", "prev_lat", "prev_lng")


def speed_for_display(kmh, unit) -> Column:
    c = lambda v: F.col(v) if isinstance(v, str) else v
    return F.floor(F.when(c(unit) == "mph", c(kmh) * 0.621371).otherwise(c(kmh)) + 0.5).cast("long")


def speeding_episodes(fixes: DataFrame) -> DataFrame:
    """Contiguous runs over the limit: session_id, start_ms, end_ms, fixes, top."""
    over = F.coalesce(F.col("speed_kmh") > F.col("speed_limit_kmh"), F.lit(False))
    rows = running(fixes.withColumn("_over", over), "_run", F.when(F.col("_over"), 0).otherwise(1), "sum", "session_id", ORDER)
    return rows.filter("_over").groupBy("session_id", "_run").agg(
        F.min("fix_ms").alias("start_ms"), F.max("fix_ms").alias("end_ms"), F.count(F.lit(1)).alias("fixes"),
        F.max("speed_kmh").alias("top_kmh")).drop("_run")


def off_route_counts(fixes: DataFrame, limit_m: float = 45.0) -> DataFrame:
    """Number of consecutive fixes farther than 45 m from the route."""
    rows = fixes.withColumn("_off", F.coalesce((F.col("off_route_m") > limit_m).cast("int"), F.lit(0)))
    rows = running(rows, "_all", F.col("_off"), "sum", "session_id", ORDER)
    # What had been counted when the route was last held; the count starts again from there.
    rows = running(rows, "_held", F.when(F.col("_off") == 0, F.col("_all")), "last", "session_id", ORDER)
    return rows.withColumn("off_count", F.col("_all") - F.coalesce("_held", F.lit(0))).drop("_off", "_all", "_held")


def dark_state(readings: DataFrame, value: str, order: list[str], key: str = "session_id") -> DataFrame:
    """Dark below 30, bright above 80, unchanged in between; bright at first."""
    mark = F.when(F.col(value) < 30, True).when(F.col(value) > 80, False)
    return running(readings, "is_dark", mark, "last", key, order).withColumn("is_dark", F.coalesce("is_dark", F.lit(False)))


def dark_theme(is_dark, in_tunnel, sun_altitude) -> Column:
    c = lambda v: F.col(v) if isinstance(v, str) else v
    return F.coalesce(c(is_dark), F.lit(False)) | F.coalesce(c(in_tunnel), F.lit(False)) | F.coalesce(
        c(sun_altitude) < -0.02, F.lit(False))


def last_of_burst(requests: DataFrame, gap: str = "300 milliseconds", event_time: str = "ts",
                  key: str = "session_id") -> DataFrame:
    """Debounce: only the last request of a burst; works on streams as well."""
    others = [c for c in requests.columns if c not in (key, event_time)]
    window = F.session_window(event_time, gap)
    return requests.groupBy(key, window).agg(F.max_by(F.struct(event_time, *others), F.struct(event_time, *others)).alias("_l"),
                                             F.count(F.lit(1)).alias("burst")).select(key, "_l.*", "burst")


def trips(events: DataFrame, gap: str = "12 hours", event_time: str = "ts", key: str = "session_id") -> DataFrame:
    """Sessions that may be resumed: activity with gaps under twelve hours."""
    window = F.session_window(event_time, gap)
    return events.groupBy(key, window).agg(F.min(event_time).alias("started"), F.max(event_time).alias("last_seen"),
                                           F.count(F.lit(1)).alias("events")).drop("session_window")


def latest_results(results: DataFrame, key: str = "request_key", generation: str = "generation") -> DataFrame:
    """Newest generation of every request; older late answers are ignored."""
    row = F.struct(*[F.col(c) for c in results.columns if c != key])
    return results.groupBy(key).agg(F.max_by(row, F.col(generation)).alias("_r")).select(key, "_r.*")


def lookups_with_ttl(requests: DataFrame, key: str = "cell", ttl: str = "15 minutes", event_time: str = "ts") -> DataFrame:
    """Stream: one look-up per key within the time to live."""
    return requests.withWatermark(event_time, ttl).dropDuplicatesWithinWatermark([key])


def first_usable_fix(fixes: DataFrame) -> DataFrame:
    """Start of a session: the first fix within 30 m, else the best within 50 m."""
    usable = fixes.filter((F.col("accuracy") > 0) & (F.col("accuracy") <= 50))
    quick = F.col("accuracy") <= 30
    rank = F.struct(F.when(quick, 0).otherwise(1), F.when(quick, F.lit(0.0)).otherwise(F.col("accuracy")), "fix_ms", "fix_id")
    best = usable.groupBy("session_id").agg(F.min_by(F.struct("fix_id", "fix_ms", "accuracy"), rank).alias("_b"))
    return best.select("session_id", "_b.*")


def accuracy_metadata(source, explicit_level=None, explicit_source=None) -> tuple[Column, Column]:
    """(confidence, accuracy source) of a fix: native radius 68 %, web 95 %."""
    is_native = F.coalesce(F.col(source).startswith("native-"), F.lit(False))
    level = F.when(is_native, 0.68).otherwise(0.95)
    name = F.when(is_native, "android-location-horizontal-68").otherwise("w3c-geolocation-horizontal-95")
    if explicit_level is not None:
        given = F.col(explicit_level)
        level = F.when((given > 0) & (given < 1), given).otherwise(level)
    if explicit_source is not None:
        name = F.coalesce(F.nullif(F.trim(F.col(explicit_source)), F.lit("")), name)
    return level, name


def eta_uncertainty_s(accuracy, remaining_m, remaining_s) -> Column:
    """Seconds the position radius stands for at the route's mean speed."""
    a, m, s = (F.col(v) if isinstance(v, str) else v for v in (accuracy, remaining_m, remaining_s))
    return F.when((a > 0) & (m > 0) & (s > 0), a / (m / s))
