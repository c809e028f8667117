"""Functions for use in SQL text."""

from __future__ import annotations

import math

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from .ephemeris import spa_ephemeris
from .geo import EARTH_RADIUS_M

POINT_ROWS = "v_idx: bigint, target_m: double, lat: double, lng: double"


def _metres(a, b) -> float:
    p, q = math.radians(a["lat"]), math.radians(b["lat"])
    h = (math.sin((q - p) / 2) ** 2
         + math.cos(p) * math.cos(q) * math.sin(math.radians(b["lng"] - a["lng"]) / 2) ** 2)
    return 2 * EARTH_RADIUS_M * math.atan2(math.sqrt(h), math.sqrt(1 - h))


@udtf(returnType=POINT_ROWS)
class ResampleRoute:
    """``resample_route(geometry, interval)``: points every ``interval`` metres and at both ends.

    ``geometry`` is an array of (lat, lng) structs. NULL or fewer than two
    points give no row, a length of zero gives the first point.
    """

    def eval(self, geometry, interval: float):
        if geometry is None or len(geometry) < 2 or not interval or interval <= 0:
            return
        at, due, n = 0.0, 0.0, 0
        for a, b in zip(geometry, geometry[1:]):
            length = _metres(a, b)
            while due < at + length:
                t = (due - at) / length
                yield n, due, a["lat"] + (b["lat"] - a["lat"]) * t, a["lng"] + (b["lng"] - a["lng"]) * t
                n += 1
                due = n * interval
            at += length
        yield n, at, geometry[-1]["lat"], geometry[-1]["lng"]


def register_functions(spark: SparkSession) -> None:
    """Make ``spa_ephemeris(ms, delta_t)`` and the table function ``resample_route`` known to SQL."""
    spark.udf.register("spa_ephemeris", spa_ephemeris)
    spark.udtf.register("resample_route", ResampleRoute)
