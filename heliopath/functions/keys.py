"""Identity keys, fixed-decimal texts and safe paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import col


def fixed(value, digits: int) -> Column:
    """Text with a fixed number of decimals, without a negative zero.

    The exact binary value is rounded, not its shortest decimal text.
    """
    text = F.replace(F.format_number(col(value), digits), F.lit(","), F.lit(""))
    return F.when(col(value).isNotNull(), F.regexp_replace(text, r"^-(0(?:\.0+)?)$", "$1"))


def quantize_point(lat, lng, digits: int = 5) -> Column:
    return F.concat_ws(",", fixed(lat, digits), fixed(lng, digits))


def country_cell(lat, lng) -> Column:
    """About 110 m: one place lookup serves a cell."""
    return quantize_point(lat, lng, 3)


def coordinate_part(lat, lng) -> Column:
    return F.when(col(lat).isNotNull() & col(lng).isNotNull(), quantize_point(lat, lng, 6)).otherwise("invalid")


def route_request_key(start, end, mode, toll_free, departure_ms=None) -> Column:
    """start|end|mode|toll class|time; a NULL time means a live request."""
    time_part = F.lit("realtime") if departure_ms is None else F.coalesce(
        col(departure_ms).cast("string"), F.lit("time-unknown"))
    return F.concat_ws("|", coordinate_part(*start), coordinate_part(*end), F.coalesce(col(mode), F.lit("")),
                       F.when(col(toll_free), "toll-free").otherwise("standard"), time_part)


# Fixed value: how many points of a route its identity holds.
IDENTITY_SAMPLES = 12


def geometry_signature(samples) -> Column:
    """Text of sampled (lat, lng) points with 4 decimals, lng first."""
    return F.array_join(F.transform(col(samples), lambda p: F.concat_ws(",", fixed(p["lng"], 4), fixed(p["lat"], 4))), ";")


def route_identity(distance, duration, first, last, signature, index) -> Column:
    """Identity of a candidate: totals, end points and the sampled signature."""
    values = [col(distance), col(duration), *(col(v) for v in first), *(col(v) for v in last)]
    usable = values[0].isNotNull()
    for value in values[1:]:
        usable = usable & value.isNotNull()
    head = F.concat_ws("-", *[fixed(v, 5) for v in values])
    return F.when(usable, F.concat(F.lit("route-"), head, F.lit("-"), col(signature))).otherwise(
        F.concat(F.lit("route-index-"), col(index).cast("string"), F.lit("-"), col(signature)))


def compact_id(text) -> Column:
    return F.sha2(col(text), 256)


def safe_relative_path(path) -> Column:
    """Normalised relative path; NULL when absolute, empty or leaving its root."""
    text = F.regexp_replace(F.regexp_replace(F.coalesce(col(path), F.lit("")), r"\\", "/"), r"^\./", "")
    bad = (text == "") | text.startswith("/") | F.array_contains(F.split(text, "/"), "..")
    return F.when(~bad, text)
