"""Removing secrets and exact places from log details."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

# Words that mark a secret, names that mark a place, and limits.
SECRET_WORDS = ("password", "token", "secret", "authorization")
PLACE_KEYS = ("coords", "position", "location")
MAX_CHARS, MAX_ITEMS, MAX_KEYS, MAX_DEPTH = 300, 32, 64, 3


def redact_props(props) -> Column:
    """Flat map of texts: secret keys go, long texts are cut; 64 keys at most."""
    m = F.col(props) if isinstance(props, str) else props
    secret = lambda k: F.greatest(*[F.lower(k).contains(w) for w in SECRET_WORDS])
    first = F.map_from_entries(F.slice(F.map_entries(m), 1, MAX_KEYS))
    cut = lambda k, v: F.when(F.length(v) > MAX_CHARS, F.concat(F.substring(v, 1, MAX_CHARS), F.lit("…"))).otherwise(v)
    return F.transform_values(F.map_filter(first, lambda k, v: ~secret(k)), cut)


def mask_location(lat, lng) -> tuple[Column, Column]:
    from ..functions.geo import half_up

    return half_up(lat, 3), half_up(lng, 3)


@pandas_udf(StringType())
def sanitize_json(texts: pd.Series) -> pd.Series:
    """Nested details, which have no fixed schema: same rules at every depth."""
    gone = object()

    def clean(value, key, depth):
        if any(w in key.lower() for w in SECRET_WORDS):
            return gone
        if isinstance(value, (dict, list)) and (key in PLACE_KEYS or (
                isinstance(value, dict) and {"lat", "lng"} <= value.keys())):
            try:
                return {k: round(float(value[k]), 3) for k in ("lat", "lng")}
            except (KeyError, TypeError, ValueError):
                return gone
        if depth > MAX_DEPTH:
            return "[truncated]"
        if isinstance(value, list):
            items = [clean(v, "", depth + 1) for v in value[:MAX_ITEMS]]
            return [None if v is gone else v for v in items]
        if isinstance(value, dict):
            pairs = [(k, clean(v, k, depth + 1)) for k, v in list(value.items())[:MAX_KEYS]]
            return {k: v for k, v in pairs if v is not gone}
        if isinstance(value, str) and len(value) > MAX_CHARS:
            return value[:MAX_CHARS] + "…"
        return value

    return texts.map(lambda t: None if t is None else json.dumps(clean(json.loads(t), "", 0), ensure_ascii=False))
