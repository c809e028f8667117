"""Mixing sources to target weights, in DataFrame functions only.

Every row gets a hash-random key; its leading digits are a range of keys
within the source. Sums per (source, range) give each range's offset, a
window inside one range gives each row's, so that no source, however large,
meets in one task. A source's budget is cut exactly: all rows are taken as
often as the budget holds the whole source, then rows in key order up to the
budget's last word, so that one row of a source may be taken in part.

A null or empty text has size 0 and is taken 0 times. A null source is a source
of its own, last in order. Rows with the same id are ordered by size and text.
An empty table gives an empty result; where no text has a word all targets are 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import word_count

DIGITS = 3  # leading hexadecimal digits of a key: 4096 ranges a source


def source_targets(totals: DataFrame, weights: tuple[int, ...], most_epochs: int) -> DataFrame:
    """(name, missing, source_size) with each source's target, one row per source.

    All sizes are shared by weight; a source stops at ``most_epochs`` times its
    size and the rest is shared again. With sources in order of size by weight
    that is one level: the first source that the rest would not fill sets it.
    """
    order = Window.orderBy("missing", "name")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(order) - 1) % len(weights) + 1)
    most = most_epochs * F.col("source_size")
    by_fill = Window.orderBy(F.col("source_size") / F.col("weight"), "missing", "name")
    before, everything = by_fill.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    filled = F.coalesce(F.sum(most).over(before), F.lit(0))
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    level = (F.sum("source_size").over(everything) - filled) / weight_left
    return (
        totals.withColumn("weight", weight).withColumn("place", F.row_number().over(by_fill)).withColumn("level", level)
        .withColumn("level", F.min_by(F.when(most / F.col("weight") > F.col("level"), F.col("level")),
                                      F.when(most / F.col("weight") > F.col("level"), F.col("place"))).over(everything))
        .withColumn("target", F.coalesce(F.least(most.cast("double"), F.col("weight") * F.col("level")), F.lit(0.0)))
        .drop("weight", "place", "level"))


def mix(docs: DataFrame, carry: list[str], weights: tuple[int, ...] = (1, 2, 3), most_epochs: int = 3,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Every row as ``row`` (the columns of ``carry``) with size, source_size, target, epochs, cut and taken.

    ``epochs`` is how often the row is taken whole, ``cut`` the words of it taken once more (fewer than ``size``).
    """
    key = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    rows = docs.select(
        F.coalesce(F.col(source_col), F.lit("")).alias("name"), F.col(source_col).isNull().alias("missing"),
        key.alias("key"), F.substring(key, 1, DIGITS).alias("range"), word_count(F.col(text_col)).alias("size"),
        F.xxhash64(text_col).alias("tie"), F.struct(*carry).alias("row"))
    source = ["missing", "name"]
    ranges = rows.groupBy(*source, "range").agg(F.sum("size").alias("range_size"))
    earlier = Window.partitionBy(*source).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.withColumn("offset", F.coalesce(F.sum("range_size").over(earlier), F.lit(0))).drop("range_size")
    targets = source_targets(ranges.groupBy(*source).agg(F.sum("range_size").alias("source_size")), weights, most_epochs)
    known = offsets.join(targets, source)
    inside = (Window.partitionBy(*source, "range").orderBy("key", "size", "tie")
              .rowsBetween(Window.unboundedPreceding, -1))
    budget = F.floor("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    left = budget - F.col("epochs") * F.col("source_size") - F.col("before")
    cut: Column = F.greatest(F.lit(0), F.least(F.col("size"), left)).cast("long")
    return (
        rows.join(known, [*source, "range"])
        .withColumn("before", F.col("offset") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .withColumn("epochs", whole).withColumn("cut", cut)
        .withColumn("epochs", F.col("epochs") + ((F.col("cut") == F.col("size")) & (F.col("size") > 0)).cast("long"))
        .withColumn("cut", F.when(F.col("cut") == F.col("size"), 0).otherwise(F.col("cut")))
        .withColumn("taken", F.col("epochs") * F.col("size") + F.col("cut"))
        .select("row", "size", "source_size", "target", "epochs", "cut", "taken"))


def mixed(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The mix itself: rows repeated as taken, the last row of a budget with the words that fit."""
    names = docs.columns
    rows = mix(docs, names, text_col=text_col, **options)
    copies = F.flatten(F.array(F.array_repeat(F.lit(False), F.col("epochs").cast("int")),
                               F.array_repeat(F.lit(True), (F.col("cut") > 0).cast("int"))))
    spread = rows.select("row", "cut", F.explode(copies).alias("partly"))
    pieces = F.split(F.col(f"row.{text_col}"), r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    shortened = F.array_join(F.slice(pieces, 1, F.col("cut").cast("int")), "")
    text = F.when(F.col("partly"), shortened).otherwise(F.col(f"row.{text_col}"))
    return spread.select(*[(text if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in names])
