"""Running values of long sessions or routes, worked out block by block.

A window over a whole session would put a never-ending session into one task.
Here each day of a session (or block of another order) is a window of its own; one value per session and
day is carried over to the later days in a second, small window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY_MS = 24 * 3600 * 1000


def _dated(rows: DataFrame, at: str, block: int = DAY_MS) -> DataFrame:
    kind = dict(rows.dtypes)[at]
    ms = F.unix_millis(F.col(at).cast("timestamp")) if kind.startswith("timestamp") else F.col(at)
    return rows.withColumn("_day", F.floor(ms / block))


def _local(key: str, order: list[str]):
    return Window.partitionBy(key, "_day").orderBy(*order)


def _with_carried(rows: DataFrame, days: DataFrame, carried: Column, key: str) -> DataFrame:
    """Join to every row the value its day gets from earlier days."""
    before = Window.partitionBy(key).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(days.select(key, "_day", carried.over(before).alias("_carried")), [key, "_day"], "left")


def with_previous(rows: DataFrame, names: list[str], key: str, order: list[str]) -> DataFrame:
    """Add ``prev_<name>`` from the preceding row of the session."""
    dated = _dated(rows, order[0])
    own = F.struct(*names)
    days = dated.groupBy(key, "_day").agg(F.max_by(own, F.struct(*order)).alias("_end"))
    dated = dated.withColumn("_prev", F.lag(own).over(_local(key, order)))
    out = _with_carried(dated, days, F.last("_end", ignorenulls=True), key)
    out = out.withColumn("_prev", F.coalesce("_prev", "_carried"))
    return out.withColumns({f"prev_{n}": F.col(f"_prev.{n}") for n in names}).drop("_day", "_prev", "_carried")


def running(rows: DataFrame, name: str, value: Column, how: str, key: str, order: list[str], block: int = DAY_MS) -> DataFrame:
    """Add the running ``sum``, ``max`` or ``last`` non-null of ``value`` up to each row of the session.

    Blocks are ``block`` wide in the first order column.
    """
    dated = _dated(rows, order[0], block).withColumn("_value", value)
    local = _local(key, order).rowsBetween(Window.unboundedPreceding, 0)
    if how == "last":
        mark = F.when(F.col("_value").isNotNull(), F.struct(*order))
        days = dated.groupBy(key, "_day").agg(F.max_by("_value", mark).alias("_total"))
        carried, inside = F.last("_total", ignorenulls=True), F.last("_value", ignorenulls=True).over(local)
        joined = lambda here: F.coalesce(here, "_carried")
    else:
        total = F.sum if how == "sum" else F.max
        days = dated.groupBy(key, "_day").agg(total("_value").alias("_total"))
        carried, inside = total("_total"), total("_value").over(local)
        joined = (lambda here: here + F.coalesce("_carried", F.lit(0))) if how == "sum" else (lambda here: F.greatest(here, "_carried"))
    out = _with_carried(dated.withColumn("_here", inside), days, carried, key)
    return out.withColumn(name, joined(F.col("_here"))).drop("_day", "_value", "_here", "_carried")
