"""Look-ups whose answers stay good for a time: which requests ask, and whose answer serves the others.

A request asks if its key has no answer yet or the last one has run out; how long an answer lasts
depends on the request that asked (a found place longer than a failure). So each
request points to the first one of its key that would have to ask after it, and those that do ask are
found by doubling these pointers from the first request of each key: as many rounds as the
logarithm of the longest chain, however long a key's history is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from ..streaming.blocks import running

FOUND_MS, TILE_MS, FAILED_MS = 15 * 60_000, 10 * 60_000, 30_000
BLOCK_MS = 15 * 60_000


def first_after(rows: DataFrame, target: Column) -> DataFrame:
    """(key, at, id, next_at, next_id): the first row of the key at ``target`` or later, null if there is none.

    ``rows``: key, at (milliseconds), id, none null. A target meets the rows of its own block of time; if none of these is late enough, the
    head of the next block that has rows counts, found over one row per key and block.
    """
    block = lambda c: F.floor(c / BLOCK_MS)
    here = F.struct("at", "id")
    probes = rows.select("key", target.alias("mark"), F.lit(1).alias("kind"), "id", here.alias("row"))
    both = rows.select("key", F.col("at").alias("mark"), F.lit(0).alias("kind"), "id", here.alias("row")).unionByName(probes)
    both = both.withColumn("block", block(F.col("mark")))
    # Backwards in time the last row seen is the first that is late enough; at one time rows come before targets.
    back = Window.partitionBy("key", "block").orderBy(F.desc("mark"), "kind", F.desc("id")).rowsBetween(Window.unboundedPreceding, 0)
    seen = F.last(F.when(F.col("kind") == 0, F.col("row")), ignorenulls=True).over(back)
    met = both.withColumn("next", seen).filter("kind = 1").select("key", "block", "row", "next")
    heads = both.groupBy("key", "block").agg(F.min(F.when(F.col("kind") == 0, F.col("row"))).alias("head"))
    later = Window.partitionBy("key").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.select("key", "block", F.last("head", ignorenulls=True).over(later).alias("head"))
    found = met.join(heads, ["key", "block"]).withColumn("next", F.coalesce("next", "head"))
    return found.select("key", "row.at", "row.id", F.col("next.at").alias("next_at"), F.col("next.id").alias("next_id"))


def chained(starts: DataFrame, pointers: DataFrame) -> DataFrame:
    """(key, at, id) of all rows reached from ``starts`` along ``pointers`` (key, at, id, next_at, next_id)."""
    reached = cut_lineage(starts.select("key", "at", "id"))
    jumps = cut_lineage(pointers.filter("next_at is not null").distinct())
    while True:
        fresh = reached.join(jumps, ["key", "at", "id"]).select("key", F.col("next_at").alias("at"), F.col("next_id").alias("id"))
        fresh = cut_lineage(fresh)
        if fresh.isEmpty():
            return reached
        reached = cut_lineage(reached.union(fresh).distinct())
        ahead = jumps.select("key", F.col("at").alias("next_at"), F.col("id").alias("next_id"),
                             F.col("next_at").alias("far_at"), F.col("next_id").alias("far_id"))
        jumps = cut_lineage(jumps.join(ahead, ["key", "next_at", "next_id"]).select(
            "key", "at", "id", F.col("far_at").alias("next_at"), F.col("far_id").alias("next_id")))


def life_ms(found: Column, found_ms: int = FOUND_MS, failed_ms: int = FAILED_MS) -> Column:
    """How long the answer of a request lasts: places 15 minutes (tiles 10, ``TILE_MS``), failures 30 seconds."""
    return F.when(F.coalesce(found, F.lit(False)), found_ms).otherwise(failed_ms)


def timed_lookups(requests: DataFrame, life: Column, key: str = "cell", at: str = "fix_ms", row_id: str = "fix_id") -> DataFrame:
    """(key, at, row_id, asks, answered_by): every request, if it asks, and the request whose answer serves it.

    Requests of one time are in the order of their ids. An answer that ends at a request's time is used no more.
    Requests that are alike in key, time and id are one and have the longer life. Those without a key, a time
    or an id are left out; an empty table gives an empty result.
    """
    rows = (requests.select(F.col(key).alias("key"), F.col(at).alias("at"), F.col(row_id).alias("id"), life.alias("life"))
            .filter("key is not null and at is not null and id is not null")
            .groupBy("key", "at", "id").agg(F.max("life").alias("life")))
    rows = cut_lineage(rows)
    starts = rows.groupBy("key").agg(F.min(F.struct("at", "id")).alias("row")).select("key", "row.*")
    asking = chained(starts, first_after(rows, F.col("at") + F.col("life"))).withColumn("asks", F.lit(True))
    marked = rows.join(asking, ["key", "at", "id"], "left").withColumn("asks", F.coalesce("asks", F.lit(False)))
    out = running(marked, "answered_by", F.when(F.col("asks"), F.col("id")), "last", "key", ["at", "id"])
    return out.select(F.col("key").alias(key), F.col("at").alias(at), F.col("id").alias(row_id), "asks", "answered_by")
