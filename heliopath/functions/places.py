"""Place texts, address matching and country codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import col, point_in_polygon

# Conservative country outlines as (lng, lat) rings.
GREAT_BRITAIN = [
    (-5.8, 50.0), (-4.0, 50.0), (-2.0, 50.5), (0.2, 50.7), (1.8, 51.0), (1.7, 52.1), (1.3, 52.7),
    (1.7, 53.4), (0.5, 54.0), (-0.2, 54.5), (-1.4, 55.0), (-2.0, 55.6), (-3.0, 58.7), (-5.0, 58.7),
    (-6.0, 57.5), (-5.5, 56.0), (-4.7, 55.3), (-4.8, 54.5), (-3.5, 53.5), (-4.5, 52.8), (-5.3, 52.2),
    (-4.0, 51.5), (-5.2, 50.8),
]
CONTIGUOUS_US = [
    (-124.8, 48.9), (-123.2, 46.0), (-124.2, 42.0), (-120.0, 39.0), (-117.1, 32.8), (-114.7, 32.7),
    (-111.0, 31.3), (-108.2, 31.3), (-106.5, 31.8), (-104.0, 29.8), (-97.2, 25.8), (-90.1, 28.5),
    (-88.0, 30.2), (-85.0, 29.5), (-82.5, 27.0), (-80.0, 25.0), (-80.0, 31.0), (-75.0, 35.0),
    (-71.0, 41.0), (-67.0, 44.8), (-74.5, 45.0), (-79.0, 44.5), (-84.8, 46.0), (-89.5, 48.0),
    (-95.1, 49.0), (-104.0, 49.0), (-111.0, 49.0), (-120.0, 49.0), (-124.8, 48.9),
]
ALASKA_MAINLAND = [
    (-168.0, 54.5), (-160.0, 54.5), (-151.0, 57.0), (-145.0, 59.0), (-141.0, 60.5), (-141.0, 72.0),
    (-170.0, 72.0), (-173.0, 65.0), (-170.0, 60.0),
]
ALASKA_PANHANDLE = [(-135.5, 57.5), (-133.0, 57.5), (-133.0, 59.0), (-135.5, 59.0)]
# Boxes as (south, north, west, east). The first is Canadian ground
# inside the contiguous outline.
GREAT_LAKES_CANADA = (43.2, 46.0, -83.5, -77.0)
HAWAII = (18.0, 23.0, -161.0, -154.0)
KOREA = (33.0, 39.0, 124.0, 132.0)

NON_WORD = r"[^\p{L}\p{N}]+"
STREET_ADDRESS = r"^\s*\d+[A-Za-z]?\s+\S+"
HOUSE_NUMBER = r"(?i)^\d+[a-z]?$"


def normalize_country(code) -> Column:
    """Two-letter code of a free text; empty when not a code."""
    value = F.upper(F.trim(F.coalesce(col(code), F.lit(""))))
    return (F.when(value.isin("USA", "US"), "US").when(value.isin("GBR", "GB", "UK"), "GB")
            .when(value.isin("KOR", "KR"), "KR").when(value.rlike("^[A-Z]{2}$"), value).otherwise(""))


def _ring(points) -> Column:
    return F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in points])


def _inside(lat, lng, ring) -> Column:
    lngs, lats = zip(*ring)
    near = lat.between(min(lats), max(lats)) & lng.between(min(lngs), max(lngs))
    return near & point_in_polygon(lng, lat, _ring(ring))


def detect_country(lat, lng, code=None) -> Column:
    """US / GB / KR / INT: an explicit code wins over the outlines."""
    lat, lng = col(lat), col(lng)
    given = F.upper(F.trim(F.coalesce(col(code) if code is not None else F.lit(None).cast("string"), F.lit(""))))
    south, north, west, east = GREAT_LAKES_CANADA
    canada = (lat > south) & (lat < north) & (lng > west) & (lng < east)
    box = lambda b: lat.between(b[0], b[1]) & lng.between(b[2], b[3])
    states = (_inside(lat, lng, CONTIGUOUS_US) | _inside(lat, lng, ALASKA_MAINLAND)
              | _inside(lat, lng, ALASKA_PANHANDLE) | box(HAWAII))
    return (F.when(given.isin("US", "USA"), "US").when(given.isin("GB", "UK", "GBR"), "GB")
            .when(given.isin("KR", "KOR"), "KR").when(given != "", "INT")
            .when(~canada & states, "US").when(box(KOREA), "KR")
            .when(_inside(lat, lng, GREAT_BRITAIN), "GB").otherwise("INT"))


def plain_words(text) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(col(text), F.lit(""))), NON_WORD, " "))


def looks_like_street(query) -> Column:
    return col(query).rlike(STREET_ADDRESS)


def address_score(query, texts, house_number, importance) -> Column:
    """Phrase 100, share of query words 40, house number +80 or -100, importance."""
    wanted = plain_words(query)
    tokens = F.filter(F.split(wanted, r"\s+"), lambda t: t != "")
    text = plain_words(F.concat_ws(" ", *[F.nullif(col(t).cast("string"), F.lit("")) for t in texts]))
    words = F.split(text, r"\s+")
    number = F.when(F.get(tokens, F.lit(0)).rlike(HOUSE_NUMBER), F.get(tokens, F.lit(0)))
    found = F.size(F.filter(tokens, lambda t: F.array_contains(words, t)))
    score = F.when((wanted != "") & (F.instr(text, wanted) > 0), 100.0).otherwise(0.0)
    score = score + F.when(F.size(tokens) > 0, found / F.size(tokens) * 40.0).otherwise(0.0)
    score = score + F.when(number == F.lower(F.coalesce(col(house_number).cast("string"), F.lit(""))), 80.0).otherwise(0.0)
    score = score - F.when(number.isNotNull() & ~F.array_contains(words, number), 100.0).otherwise(0.0)
    score = score + F.greatest(F.lit(0.0), F.coalesce(col(importance), F.lit(0.0)))
    return F.when(text == "", 0.0).otherwise(score)


def short_address(display_name, lat, lng) -> Column:
    """First three comma parts, or the coordinates when there is no name."""
    parts = F.transform(F.split(col(display_name), ","), lambda p: F.trim(p))
    name = F.trim(F.array_join(F.slice(parts, 1, 3), ", "))
    return F.when(F.coalesce(col(display_name), F.lit("")) != "", name).otherwise(
        F.format_string("%.4f, %.4f", col(lat), col(lng)))
