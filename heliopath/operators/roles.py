"""Comparing route candidates of one origin and destination (od).

Candidates are rows: od_id, route_id, candidate_index, duration_sec, avg_glare,
sunlit_s, direct_wh, shade, analysis_mode. Winners are found with aggregates
that combine before the shuffle, so a very large od needs no special case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

MAX_DETOUR = 1.35
MAX_DURATION_RATIO = 1.60
MIN_GLARE_GAIN = 0.05
MIN_SHADE_GAIN = 0.05
MIN_ENERGY_CUT_PCT = 5.0
SUNLIT_BAND_S = 30.0
ENERGY_TIE = 0.000001


def _c(v) -> Column:
    return F.col(v) if isinstance(v, str) else v


def energy(direct_wh, exposure_units=None, legacy_units=None) -> Column:
    """Time-integrated energy, else the older mean exposure values."""
    parts = [_c(v) for v in (direct_wh, exposure_units, legacy_units) if v is not None]
    return F.coalesce(*parts, F.lit(0.0))


def sunlit_seconds(sunlit_s, ratio, analysed_s, duration_sec, direct_energy) -> Column:
    """Seconds in direct sun; without evidence a daylight route counts in full."""
    total = F.coalesce(F.when(_c(analysed_s) >= 0, _c(analysed_s)), _c(duration_sec))
    whole = F.when(_c(direct_energy) > 0, F.greatest(F.lit(0.0), _c(duration_sec))).otherwise(F.lit(0.0))
    return (F.when(_c(sunlit_s) >= 0, _c(sunlit_s))
            .when((_c(ratio) >= 0) & total.isNotNull(), _c(ratio) * F.greatest(F.lit(0.0), total))
            .otherwise(F.coalesce(whole, F.lit(0.0))))


def shade_metric(mode, confirmed_ratio, avg_shade) -> Column:
    precise = _c(mode).isin("scene", "hybrid-scene") & _c(confirmed_ratio).isNotNull()
    return F.when(precise, _c(confirmed_ratio)).otherwise(F.coalesce(_c(avg_shade), F.lit(0.0)))


def within_duration_ceiling(candidates: DataFrame, ratio: float = MAX_DURATION_RATIO) -> DataFrame:
    best = candidates.groupBy("od_id").agg(F.min("duration_sec").alias("_min"))
    return candidates.join(best, "od_id").filter(F.col("duration_sec") <= F.col("_min") * ratio).drop("_min")


def fastest(candidates: DataFrame) -> DataFrame:
    """The fastest candidate of every od; ties by candidate index."""
    row = F.struct(*[F.col(c) for c in candidates.columns if c != "od_id"])
    best = candidates.groupBy("od_id").agg(
        F.min_by(row, F.struct("duration_sec", "candidate_index")).alias("_f"))
    return best.select("od_id", "_f.*")


def tradeoffs(candidates: DataFrame, baseline: DataFrame | None = None) -> DataFrame:
    """Every candidate against its od's fastest one."""
    base = fastest(candidates) if baseline is None else baseline
    f = base.select("od_id", *[F.col(c).alias(f"f_{c}") for c in
                               ("route_id", "duration_sec", "avg_glare", "sunlit_s", "direct_wh", "shade")])
    cut = (F.col("f_direct_wh") - F.col("direct_wh")) / F.col("f_direct_wh") * 100.0
    saved = F.col("f_sunlit_s") - F.col("sunlit_s")
    return candidates.join(f, "od_id").withColumns({
        "is_fastest": F.col("route_id") == F.col("f_route_id"),
        "detour_ratio": F.when(F.col("f_duration_sec") > 0, F.col("duration_sec") / F.col("f_duration_sec")),
        "extra_s": F.greatest(F.lit(0.0), F.col("duration_sec") - F.col("f_duration_sec")),
        "glare_gain": F.coalesce("f_avg_glare", F.lit(0.0)) - F.coalesce("avg_glare", F.lit(0.0)),
        "energy_cut_pct": F.when(F.col("f_direct_wh") > 0.00001, F.greatest(F.lit(0.0), cut)).otherwise(F.lit(0.0)),
        "shade_gain": F.col("shade") - F.col("f_shade"),
        "sunlit_saved_s": saved,
        "sunlit_saved_pct": F.when(F.col("f_sunlit_s") > 0.5, F.greatest(
            F.lit(0.0), saved / F.col("f_sunlit_s") * 100.0)).otherwise(F.lit(0.0)),
    })


def meaningful_glare() -> Column:
    return F.coalesce((F.col("detour_ratio") <= MAX_DETOUR) & (F.col("glare_gain") >= MIN_GLARE_GAIN), F.lit(False))


def meaningful_shade() -> Column:
    tied = F.abs("sunlit_saved_s") <= SUNLIT_BAND_S
    better = (F.col("sunlit_saved_s") >= SUNLIT_BAND_S) | (tied & (F.col("energy_cut_pct") >= MIN_ENERGY_CUT_PCT))
    return F.coalesce((F.col("detour_ratio") <= MAX_DETOUR) & better, F.lit(False))


def promising_shade() -> Column:
    hint = (F.col("energy_cut_pct") >= MIN_ENERGY_CUT_PCT) | (F.col("shade_gain") >= MIN_SHADE_GAIN)
    return F.coalesce((F.col("detour_ratio") <= MAX_DETOUR) & (meaningful_shade() | hint), F.lit(False))


def _glare_winner(pool: DataFrame) -> DataFrame:
    return pool.groupBy("od_id").agg(F.min_by(
        F.struct("route_id"), F.struct("avg_glare", "extra_s", "candidate_index")).alias("_w")
    ).select("od_id", F.col("_w.route_id").alias("glare_route_id"))


def _shade_winner(pool: DataFrame) -> DataFrame:
    """Within 30 s of the least sunlit time: least energy, then duration, then index.

    The band is anchored at the minimum of the pool, which makes the order
    independent of the input order.
    """
    least = pool.groupBy("od_id").agg(F.min("sunlit_s").alias("_least"))
    band = pool.join(least, "od_id").filter(F.col("sunlit_s") <= F.col("_least") + SUNLIT_BAND_S)
    low = band.groupBy("od_id").agg(F.min("direct_wh").alias("_low"))
    band = band.join(low, "od_id").filter(F.col("direct_wh") - F.col("_low") <= ENERGY_TIE)
    return band.groupBy("od_id").agg(F.min_by(
        F.struct("route_id"), F.struct("duration_sec", "candidate_index")).alias("_w")
    ).select("od_id", F.col("_w.route_id").alias("shade_route_id"))


def select_roles(candidates: DataFrame) -> DataFrame:
    """fastest_route_id, glare_route_id and shade_route_id of every od."""
    return _roles_of(tradeoffs(candidates))


def _roles_of(scored: DataFrame) -> DataFrame:
    others = scored.filter(~F.col("is_fastest"))
    base = scored.filter("is_fastest").select("od_id", F.col("route_id").alias("fastest_route_id"))
    out = base.join(_glare_winner(others.filter(meaningful_glare())), "od_id", "left").join(
        _shade_winner(others.filter(meaningful_shade())), "od_id", "left")
    return out.select("od_id", "fastest_route_id",
                      F.coalesce("glare_route_id", "fastest_route_id").alias("glare_route_id"),
                      F.coalesce("shade_route_id", "fastest_route_id").alias("shade_route_id"))


def precision_shortlist(candidates: DataFrame, max_candidates: int = 5, preferred: str = "glare") -> DataFrame:
    """At most five distinct routes per od worth the expensive scene analysis.

    Order: preferred role, fastest, the other role, two by glare, two by shade
    promise. Row-number limits are applied before the shuffle by the planner.
    """
    # Each is read several times below, so each is written once.
    scored = cut_lineage(tradeoffs(candidates))
    roles = cut_lineage(_roles_of(scored))
    top = lambda *order: F.row_number().over(Window.partitionBy("od_id").orderBy(*order)) <= 2
    glare2 = scored.filter(F.col("is_fastest") | meaningful_glare()).withColumn(
        "_n", F.row_number().over(Window.partitionBy("od_id").orderBy("avg_glare", "candidate_index"))).filter("_n <= 2")
    shade2 = scored.filter(F.col("is_fastest") | promising_shade()).withColumn(
        "_n", F.row_number().over(Window.partitionBy("od_id").orderBy(
            F.round("direct_wh", 3), F.desc("shade"), "candidate_index"))).filter("_n <= 2")
    signal = shade2.filter(~F.col("is_fastest")).groupBy("od_id").agg(
        F.min_by("route_id", "_n").alias("_signal"))
    if preferred == "shade":
        first = roles.join(signal, "od_id", "left").select(
            "od_id", F.coalesce("_signal", "shade_route_id").alias("route_id"))
        other = "glare_route_id"
    else:
        first = roles.select("od_id", F.col("fastest_route_id" if preferred == "fastest" else "glare_route_id").alias("route_id"))
        other = "shade_route_id"
    ranked = first.withColumn("_p", F.lit(0))
    for place, name in ((1, "fastest_route_id"), (2, other)):
        ranked = ranked.unionByName(roles.select("od_id", F.col(name).alias("route_id")).withColumn("_p", F.lit(place)))
    for base, rows in ((3, glare2), (5, shade2)):
        ranked = ranked.unionByName(rows.select("od_id", "route_id", (F.col("_n") + (base - 1)).alias("_p")))
    each = ranked.groupBy("od_id", "route_id").agg(F.min("_p").alias("_p"))
    w = Window.partitionBy("od_id").orderBy("_p")
    return each.withColumn("priority", F.row_number().over(w)).filter(
        F.col("priority") <= max_candidates).drop("_p")


def comparable_tier(candidates: DataFrame, refined: DataFrame) -> DataFrame:
    """Candidates as their od's baseline tier allows them to be compared.

    ``refined`` holds route_id, ready, analysis_mode and the refined metrics. If
    the fastest candidate was refined, only candidates refined in exactly its
    mode stay, with refined metrics; otherwise all stay with heuristic ones.
    """
    metrics = ["avg_glare", "sunlit_s", "direct_wh", "shade"]
    r = refined.filter("ready").select("route_id", F.col("analysis_mode").alias("_mode"),
                                       *[F.col(m).alias(f"_r_{m}") for m in metrics])
    base = fastest(candidates).select("od_id", "route_id").join(r.select("route_id", "_mode"), "route_id", "left")
    base = base.select("od_id", F.col("_mode").alias("baseline_mode"))
    rows = candidates.join(r, "route_id", "left").join(base, "od_id")
    rows = rows.filter(F.col("baseline_mode").isNull() | (F.col("_mode") == F.col("baseline_mode")))
    precise = F.col("baseline_mode").isNotNull()
    out = rows.withColumns({m: F.when(precise, F.col(f"_r_{m}")).otherwise(F.col(m)) for m in metrics})
    out = out.withColumn("analysis_mode", F.coalesce("baseline_mode", F.lit("heuristic")))
    return out.drop("_mode", "baseline_mode", *[f"_r_{m}" for m in metrics])


def exposure_reductions(candidates: DataFrame, roles: DataFrame, has_sun: Column | None = None) -> DataFrame:
    """Whole-percent energy cut of the two role routes, 0 below 1 %, at most 99."""
    e = candidates.select("route_id", "direct_wh")
    out = roles
    for role in ("fastest", "glare", "shade"):
        out = out.join(e.select(F.col("route_id").alias(f"{role}_route_id"), F.col("direct_wh").alias(f"{role}_wh")),
                       f"{role}_route_id")
    sun = (F.col("fastest_wh") > 0.0001) if has_sun is None else (has_sun | (F.col("fastest_wh") > 0.0001))

    def cut(role: str) -> Column:
        pct = (F.col("fastest_wh") - F.col(f"{role}_wh")) / F.col("fastest_wh") * 100.0
        usable = sun & (F.col(f"{role}_route_id") != F.col("fastest_route_id")) & (F.col("fastest_wh") > 0.00001)
        return F.when(usable & (pct >= 1), F.least(F.lit(99.0), F.floor(pct + 0.5).cast("double"))).otherwise(F.lit(0.0))

    return out.select("od_id", "fastest_route_id", "glare_route_id", "shade_route_id",
                      cut("glare").alias("glare_cut_pct"), cut("shade").alias("shade_cut_pct"),
                      (~sun).alias("is_night"))


def best_available(candidates: DataFrame) -> DataFrame:
    """Least energy within the detour limit and the fastest route's tier."""
    base = fastest(candidates).select("od_id", F.col("duration_sec").alias("_d"), F.col("analysis_mode").alias("_m"))
    pool = candidates.join(base, "od_id").filter(
        (F.col("duration_sec") <= F.col("_d") * MAX_DETOUR) & (F.col("analysis_mode") == F.col("_m")))
    return pool.groupBy("od_id").agg(F.min_by(
        F.struct("route_id", "direct_wh"), F.struct("direct_wh", "candidate_index")).alias("_b")
    ).select("od_id", F.col("_b.route_id").alias("best_route_id"), F.col("_b.direct_wh").alias("best_wh"))


def compare_routes(candidates: DataFrame, refine) -> DataFrame:
    """From candidates to roles: ceiling, shortlist, refinement, tier, reductions.

    ``refine`` maps the shortlisted rows to refined metrics (see
    ``comparable_tier``). The stage results are read several times each, so they
    are written once rather than recomputed.
    """
    pool = cut_lineage(within_duration_ceiling(candidates))
    listed = cut_lineage(pool.join(precision_shortlist(pool), ["od_id", "route_id"], "left_semi"))
    tier = cut_lineage(comparable_tier(listed, refine(listed)))
    return exposure_reductions(tier, select_roles(tier))


def via_budget(distinct_direct, requested: int = 2) -> Column:
    return F.when(_c(distinct_direct) >= 3, 0).otherwise(min(2, max(0, requested)))


def via_points(ods: DataFrame) -> DataFrame:
    """Four lateral via points per (od_id, lat1, lng1, lat2, lng2), numbered 1..4."""
    out = ods.withColumns({"_mlat": (F.col("lat1") + F.col("lat2")) / 2, "_mlng": (F.col("lng1") + F.col("lng2")) / 2,
                           "_dlat": F.col("lat2") - F.col("lat1"), "_dlng": F.col("lng2") - F.col("lng1")})
    cos_lat = F.cos(F.radians("_mlat"))
    cos_lat = F.when(cos_lat == 0, F.lit(1.0)).otherwise(cos_lat)
    out = out.withColumns({"_plat": -F.col("_dlng") / cos_lat, "_plng": F.col("_dlat") * cos_lat})
    norm = F.sqrt(F.col("_plat") * F.col("_plat") + F.col("_plng") * F.col("_plng"))
    span = F.sqrt(F.col("_dlat") * F.col("_dlat") + F.col("_dlng") * F.col("_dlng"))
    out = out.withColumns({"_norm": F.when(norm == 0, F.lit(1.0)).otherwise(norm),
                           "_off": F.least(F.lit(0.015), F.greatest(F.lit(0.0015), span * 0.18))})
    # Side and scale of the four offsets.
    sides = [(1.0, 1.0), (-1.0, 1.0), (1.0, 1.8), (-1.0, 1.8)]
    points = F.array(*[F.struct(
        F.lit(n).alias("via_no"),
        (F.col("_mlat") + side * F.col("_plat") / F.col("_norm") * F.col("_off") * k).alias("via_lat"),
        (F.col("_mlng") + side * F.col("_plng") / F.col("_norm") * F.col("_off") * k).alias("via_lng"))
        for n, (side, k) in enumerate(sides, 1)])
    return out.select("od_id", F.explode(points).alias("_v")).select("od_id", "_v.*")


def candidate_union(direct: DataFrame, via: DataFrame, od: str = "od_id", order: str = "candidate_index") -> DataFrame:
    """All direct and via candidates of a pair, direct ones first, numbered anew.

    Nothing is merged here; equal routes are removed by the duplicate rule later.
    A pair has a handful of candidates, so its window is small.
    """
    both = direct.withColumn("_via", F.lit(0)).unionByName(via.withColumn("_via", F.lit(1)), allowMissingColumns=True)
    number = F.row_number().over(Window.partitionBy(od).orderBy("_via", order)) - 1
    return both.withColumn(order, number.cast("long")).withColumn(
        "origin", F.when(F.col("_via") == 1, "via").otherwise("direct")).drop("_via")
