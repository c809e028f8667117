"""Merkle manifest of a table: leaves per row, a tree per group, a root over the groups, proofs by a recursive climb.

H is sha256 over concatenated texts, digests as lower-case hexadecimal. A leaf
is H of a row's fields in order: ``-`` for null, else the UTF-8 byte count, a colon
and the value. Leaves of a group ascend by id (nulls first, of equal ids by
digest); every two consecutive nodes become their H, a last one alone becomes H of
itself, until one is left, the group's subroot. Subroots in order of the group (null first, bytewise) are
the leaves of the last tree, whose top is the root.

Built levels are kept as node rows, each linked to a parent ``STRIDE`` levels
above it and holding the digests left and right of its path on every level between, so
a node's row has at most ``STRIDE`` siblings and a group of 2^STRIDE nodes is
the most that one array has. Ascending is one recursive query: each step joins the climbing rows with
the node they stand on, folds the digest over the node's siblings and appends these to the proof.

Leaves are numbered without meeting in one task: rows are dealt by ranges of
(group, id, digest), and the rows of earlier ranges are added up. Repeated rows
are leaves of their own with the proof of their own place. An empty table has no leaves and no root.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import stored

STRIDE = 10
SALTS = 64  # rows that stand on one upper node are joined in so many parts


def digest(*parts: Column) -> Column:
    """H of texts, as 32 bytes."""
    return F.unhex(F.sha2(F.concat(*parts), 256))


def text_of(column: Column) -> Column:
    return F.lower(F.hex(column))


def field(column: Column) -> Column:
    value = column.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """The rows with ``idx``, their place from 0 in their group, and ``tree``, the group's place from 1 (null first)."""
    held = stored(rows.repartitionByRange(F.col(group).asc_nulls_first(), *order)
                  .sortWithinPartitions(F.col(group).asc_nulls_first(), *order)
                  .withColumn("at", F.monotonically_increasing_id()).withColumn("range", F.spark_partition_id()))
    ranges = held.groupBy(group, "range").agg(F.count("*").alias("n"), F.min("at").alias("from"))
    earlier = Window.partitionBy(group).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    trees = ranges.select(group).distinct().withColumn("tree", F.row_number().over(Window.orderBy(F.col(group).asc_nulls_first())))
    begins = (ranges.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
              .join(trees.select(F.col(group).alias("own"), "tree"), F.col(group).eqNullSafe(F.col("own"))))
    begins = begins.select(F.col("range").alias("in_range"), F.col("own").alias("in_group"), "from", "before", "tree")
    return (held.join(begins, (F.col("range") == F.col("in_range")) & F.col(group).eqNullSafe(F.col("in_group")))
            .withColumn("idx", F.col("at") - F.col("from") + F.col("before"))
            .drop("at", "range", "in_range", "in_group", "from", "before"))


def node_id(tier: int | Column, tree: Column, idx: Column) -> Column:
    """Tier (3 bits), tree (20) and place (40) in one number."""
    tier = F.lit(tier) if isinstance(tier, int) else tier
    return F.shiftleft(tier.cast("long"), 60) + F.shiftleft(tree.cast("long"), 40) + idx


def _levels(last: Column) -> Column:
    """Levels that a run of nodes 0 to ``last`` needs to become one."""
    return F.when(last == 0, 0).otherwise(F.char_length(F.bin(last))).cast("int")


def _pairs(level: Column) -> Column:
    """The level above: H of every two digests, of a last one alone."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(level) - 1) / 2).cast("int")), lambda j: digest(
        text_of(F.element_at(level, 2 * j + 1)),
        F.when(2 * j + 2 <= F.size(level), text_of(F.element_at(level, 2 * j + 2))).otherwise(F.lit(""))))


def _climbed(nodes: DataFrame, tier: int) -> tuple[DataFrame, DataFrame]:
    """Nodes (tree, idx, h) of a tier to node rows (node, parent, rungs) and the nodes of the tier above.

    The top of a tree has no parent yet: it is null, and the tree's row above has ``done``.
    """
    count = nodes.groupBy("tree").agg(F.max("idx").alias("last"))
    chunk = F.shiftright("idx", STRIDE)
    runs = (nodes.groupBy("tree", chunk.alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("idx", "h"))).alias("members"))
            .join(count, "tree"))
    # A tree of one run ends at its top; the runs of a larger tree rise STRIDE levels each.
    rise = F.when(F.col("last") < 1 << STRIDE, _levels(F.col("last"))).otherwise(STRIDE)
    first = F.array(F.col("members.h"))
    levels = F.when(F.col("rise") == 0, first).otherwise(F.aggregate(
        F.sequence(F.lit(1), F.greatest("rise", F.lit(1))), first,
        lambda made, _: F.concat(made, F.array(_pairs(F.element_at(made, -1))))))
    built = stored(runs.withColumn("rise", rise).withColumn("levels", levels).drop("members"))

    none = F.lit(b"")

    def rung(j: Column, level: Column) -> Column:
        row = F.element_at("levels", level + 1)
        at = F.call_function("shiftright", j, level)
        left, right = at % 2 == 1, (at % 2 == 0) & (at + 1 < F.size(row))
        return F.struct(F.when(left, F.element_at(row, F.greatest(at, F.lit(1)))).otherwise(none).alias("left"),
                        F.when(right, F.element_at(row, F.least(at + 2, F.size(row)))).otherwise(none).alias("right"))

    steps = F.filter(F.sequence(F.lit(0), F.col("rise")), lambda s: s < F.col("rise"))
    one = F.col("last") < 1 << STRIDE
    each = built.withColumn("j", F.explode(F.sequence(F.lit(0), F.size(F.element_at("levels", 1)) - 1)))
    rows = each.select(
        node_id(tier, F.col("tree"), F.shiftleft("chunk", STRIDE) + F.col("j")).alias("node"), "tree",
        F.when(~one, node_id(tier + 1, F.col("tree"), F.col("chunk"))).alias("parent"),
        F.transform(steps, lambda s: rung(F.col("j"), s)).alias("rungs"))
    above = built.select("tree", F.col("chunk").alias("idx"), F.element_at(F.element_at("levels", -1), 1).alias("h"),
                         one.alias("done"))
    return rows, above


def _grown(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Node rows of every tier over leaves (tree, idx, h), and (tree, h) of the tops."""
    rows, tops, level, tier = None, None, leaves, 0
    while True:
        made, above = _climbed(level, tier)
        above = stored(above)
        ended = above.filter("done").select("tree", "h")
        rows, tops = (made, ended) if rows is None else (rows.union(made), tops.union(ended))
        level, tier = above.filter("not done").select("tree", "idx", "h"), tier + 1
        if level.isEmpty():
            return rows, tops


def build(leaves: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Over leaves (tree, idx, h): node rows (node, salt, parent, rungs), the subroots (tree, h) and the root (h).

    Tree 0 is the one over the subroots. The leaves' rows have salt 0; all
    above them stand there once for each salt, so that no step of a climb joins
    a whole tree's rows on one key.
    """
    rows, subroots = _grown(leaves)
    subroots = stored(subroots)
    top, root = _grown(subroots.select(F.lit(0).alias("tree"), (F.col("tree") - 1).cast("long").alias("idx"), "h"))
    linked = rows.withColumn("parent", F.coalesce("parent", node_id(0, F.lit(0), F.col("tree") - 1)))
    one = F.lit(0).cast("long")
    salts = F.sequence(one, F.lit(SALTS - 1).cast("long"))
    all_rows = linked.select("node", "parent", "rungs", (F.col("node") < 1 << 60).alias("low")).union(
        top.select("node", "parent", "rungs", F.lit(False)))
    dealt = all_rows.withColumn("salt", F.explode(F.when(F.col("low"), F.array(one)).otherwise(salts)))
    return stored(dealt.select("node", "salt", "parent", "rungs")), subroots, root.select("h")


CLIMB = """
WITH RECURSIVE climb(leaf, node, salt, folded, proof) AS (
  SELECT leaf, leaf, 0L, start, X'' FROM {starts}
  UNION ALL
  SELECT c.leaf, n.parent, c.leaf % {salts},
         aggregate(n.rungs, c.folded, (made, r) -> unhex(sha2(lower(hex(concat(r.left, made, r.right))), 256))),
         aggregate(n.rungs, c.proof, (made, r) -> concat(made, r.left, r.right))
  FROM climb c JOIN {nodes} n ON c.node = n.node AND c.salt = n.salt)
SELECT leaf, folded, proof FROM climb WHERE node IS NULL
"""
ROW_LIMIT = "spark.sql.cteRecursionRowLimit"


def ascended(starts: DataFrame, nodes: DataFrame) -> DataFrame:
    """(leaf, start) climbed to the root: the folded digest and all siblings passed, left to right, one after another.

    The rows are written, as the recursion's row limit is lifted for this query alone.
    """
    spark = starts.sparkSession
    starts.createOrReplaceTempView("merkle_starts")
    nodes.createOrReplaceTempView("merkle_nodes")
    before = spark.conf.get(ROW_LIMIT)
    spark.conf.set(ROW_LIMIT, "-1")
    try:
        return stored(spark.sql(CLIMB.format(starts="merkle_starts", nodes="merkle_nodes", salts=SALTS)))
    finally:
        spark.conf.set(ROW_LIMIT, before)
        spark.catalog.dropTempView("merkle_starts")
        spark.catalog.dropTempView("merkle_nodes")


def manifest(docs: DataFrame, fields: list[str], group: str, id_col: str, tampered: dict[str, Column]) -> DataFrame:
    """(id, leaf, subroot, root, proof, folded, verified) of every row; digests as 32 bytes, ``proof`` the siblings.

    ``tampered`` has other expressions for some fields; the leaf folded is that
    of the fields so changed. A row is verified if its fold gives the root.
    """
    leaf = digest(*[field(F.col(f"`{c}`")) for c in fields])
    changed = digest(*[field(tampered.get(c, F.col(f"`{c}`"))) for c in fields])
    rows = stored(docs.select(F.col(f"`{group}`").cast("string").alias("group"), F.col(f"`{id_col}`").alias("id"),
                              leaf.alias("h"), changed.alias("start")))
    leaves = stored(numbered(rows, "group", ["id", "h"]))
    nodes, subroots, root = build(leaves.select("tree", "idx", "h"))
    starts = leaves.withColumn("leaf", node_id(0, F.col("tree"), F.col("idx")))
    up = ascended(starts.select("leaf", "start"), nodes)
    top = root.first()
    known = subroots.select("tree", F.col("h").alias("subroot"), F.lit(bytes(top.h) if top else None).cast("binary").alias("root"))
    return (starts.join(up, "leaf").join(known, "tree")
            .select("id", F.col("h").alias("leaf"), "subroot", "root", "proof", "folded",
                    (F.col("folded") == F.col("root")).alias("verified")))
