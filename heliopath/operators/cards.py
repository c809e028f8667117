"""Short texts and classes shown for a route or a segment."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Explanations by reason code.
REASON_TEXTS = {
    "SCENE_MANIFEST_TIMEOUT": "scene manifest timeout",
    "SCENE_MANIFEST_UNAVAILABLE": "scene manifest unavailable",
    "SCENE_MANIFEST_HTTP_ERROR": "scene manifest server error",
    "SCENE_MANIFEST_PARSE_FAILURE": "scene manifest parse failure",
    "SCENE_PACK_DOWNLOAD_TIMEOUT": "scene tile download timeout",
    "SCENE_PACK_HTTP_ERROR": "scene tile server error",
    "SCENE_PACK_CHECKSUM_FAILURE": "scene tile checksum failure",
    "SCENE_WORKER_TIMEOUT": "scene processing timeout",
    "SCENE_DECOMPRESS_FAILURE": "scene decompression failure",
    "SCENE_JSON_PARSE_FAILURE": "scene tile parse failure",
    "SCENE_TILE_MISSING": "scene tile not available",
    "SCENE_REFINEMENT_INCOMPLETE": "scene comparison tier incomplete",
    "SCENE_DATA_UNAVAILABLE": "scene data unavailable",
}


def _c(v) -> Column:
    return F.col(v) if isinstance(v, str) else v


def _percent(v) -> Column:
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(_c(v), F.lit(0.0))))
    return F.floor(share * 100 + 0.5).cast("string")


def detour_text(duration, fastest_duration, km, fastest_km) -> Column:
    minutes = F.floor(_c(duration) / 60 + 0.5) - F.floor(_c(fastest_duration) / 60 + 0.5)
    km_gap = F.round(_c(km), 1) - F.round(_c(fastest_km), 1)
    text = F.concat(F.when(km_gap > 0, "+").otherwise("-"), F.format_number(F.abs(km_gap), 1), F.lit("km"))
    return (F.when(minutes > 0, F.concat(F.lit("+"), minutes.cast("string"), F.lit("min detour")))
            .when(minutes < 0, F.concat(minutes.cast("string"), F.lit("min faster")))
            .when(F.abs(km_gap) >= 0.05, F.concat(F.lit("Same time ("), text, F.lit(")")))
            .otherwise("Same as fastest"))


def shade_text(mode, confirmed_ratio, uncertain_ratio, estimated_ratio) -> Column:
    unsure = F.when(_percent(uncertain_ratio) != "0", F.concat(
        F.lit(" · Occlusion uncertain "), _percent(uncertain_ratio), F.lit("%"))).otherwise("")
    confirmed = F.concat(F.lit("Confirmed shade "), _percent(confirmed_ratio), F.lit("%"), unsure)
    estimated = F.concat(F.lit("Estimated shade potential "), _percent(estimated_ratio), F.lit("%"))
    return F.when(_c(mode).isin("scene", "hybrid-scene"), confirmed).otherwise(estimated)


def sunlit_text(sunlit_s, total_s) -> Column:
    s = F.greatest(F.lit(0.0), F.coalesce(_c(sunlit_s), F.lit(0.0)))
    minutes = F.when((s > 0) & (s < 60), "<1 min").otherwise(F.concat(F.floor(s / 60 + 0.5).cast("string"), F.lit(" min")))
    share = F.when(_c(total_s) > 0, _percent(s / _c(total_s))).otherwise("0")
    return F.concat(F.lit("Estimated direct-sun exposure "), minutes, F.lit(" ("), share, F.lit("%)"))


def color_class(glare, confirmed_shade, shade_state, shade_score) -> Column:
    """glare / confirmed-shade / estimated-shade / clear of a segment."""
    guess = (_c(shade_state) == "estimated-shade") & (_c(shade_score) > 0.5)
    return (F.when(_c(glare) > 0.45, "glare").when(F.coalesce(_c(confirmed_shade), F.lit(False)), "confirmed-shade")
            .when(guess, "estimated-shade").otherwise("clear"))


def scene_label(mode, reason, pending, segment_ratio, buildings, terrain, tunnels) -> Column:
    mode, reason = _c(mode), _c(reason)
    yes = lambda v: F.coalesce(_c(v), F.lit(False))
    share = F.when(_c(segment_ratio).isNotNull(), F.floor(_c(segment_ratio) * 100 + 0.5))
    texts = F.create_map(*[F.lit(v) for pair in REASON_TEXTS.items() for v in pair])
    why = F.when(F.coalesce(reason, F.lit("")) != "", F.concat(
        F.lit(" ("), F.coalesce(F.element_at(texts, reason), reason), F.lit(")"))).otherwise("")
    kept = F.when(share > 0, F.concat(F.lit(" · "), share.cast("string"), F.lit("% scene coverage retained"))).otherwise("")
    part = F.when(share.isNotNull(), F.concat(F.lit(" ("), share.cast("string"), F.lit("% of segments)"))).otherwise("")
    return (F.when(reason == "NIGHT_SCENE_NOT_NEEDED", "Night · scene analysis not needed")
            .when(yes(pending) & ~mode.isin("scene", "hybrid-scene"), "Heuristic first pass · scene refinement running")
            .when(mode == "hybrid-scene", F.concat(F.lit("Partial scene analysis"), part))
            .when((mode == "scene") & yes(buildings) & yes(terrain), "Building/terrain precision analysis")
            .when((mode == "scene") & yes(buildings), "Building data applied · terrain unavailable")
            .when((mode == "scene") & yes(tunnels), "Tunnel data only").when(mode == "scene", "Scene data applied")
            .otherwise(F.concat(F.lit("Heuristic estimate"), why, kept)))
