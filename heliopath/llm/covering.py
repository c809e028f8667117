"""SimHash fingerprints and their links within a radius, by covering masks.

A fingerprint bit is set if more than half of the hashes of the text's word
shingles have it. For radius r every bit position gets a nonzero vector of
r + 1 bits, and each of the 2^(r+1) - 1 nonzero vectors v makes a table: its
mask holds the positions whose vector has an odd product with v. At most r
differing positions span less than the whole space, so some v is orthogonal to
all of them and both fingerprints agree on that table's mask.

Equal fingerprints are collapsed first. A bucket leaves only a forest of its
links, never all pairs. A bucket of more than ``most`` fingerprints is dealt
out again by a second family of masks and, if still too large, over pairs of
blocks, each its own group; every link is found either way.

A text without words (also a null one) has fingerprint zero and is linked like
any other. Rows keep their own id; a component's id ignores null ids and is
null if it has no other. An empty table gives an empty result.
"""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .tables import parts_of, stored, texts_of

BITS, SEED = 64, 42


def fingerprint(data: bytes, width: int) -> int:
    """64 majority bits over the XXH64 of every shingle, repeats included."""
    from xxhash import xxh64_intdigest

    words = data.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate([[0], ends[:-1] + 1]).tolist()
    ends = ends.tolist()
    n = len(words) - width + 1
    set_bits = np.zeros(BITS, np.int64)
    for at in range(0, n, 50_000):
        to = min(n, at + 50_000)
        hashes = np.fromiter((xxh64_intdigest(joined[b:e], SEED)
                              for b, e in zip(begins[at:to], ends[at + width - 1:to + width - 1])), np.uint64, to - at)
        set_bits += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(set_bits * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int, carry: list, text_col: str = "text") -> DataFrame:
    """The carried columns of every row and its fingerprint ``fp`` as a signed long."""
    import pyarrow as pa

    rows = docs.select(*carry, F.col(text_col).alias("_text"))
    at = len(rows.columns) - 1

    def hashed(batches):
        for batch in batches:
            for part in parts_of(batch, text=at):
                fps = np.fromiter((fingerprint(d, width) for d in texts_of(part.column(at))), np.uint64, part.num_rows)
                yield pa.RecordBatch.from_arrays([*part.columns[:at], pa.array(fps.view(np.int64))],
                                                 [*part.schema.names[:at], "fp"])

    return rows.mapInArrow(hashed, T.StructType([*rows.drop("_text").schema, T.StructField("fp", T.LongType())]))


def covering_masks(radius: int, family: int) -> list[int]:
    """Signed 64-bit masks; families differ in the vectors dealt to the positions."""
    tables = (1 << radius + 1) - 1
    place = random.Random(family).sample(range(BITS), BITS)
    vector = [1 + place[i] % tables for i in range(BITS)]
    masks = [sum(1 << i for i in range(BITS) if (vector[i] & v).bit_count() & 1) for v in range(1, tables + 1)]
    return [m - (1 << BITS) if m >> BITS - 1 else m for m in masks]


def forest(fps: np.ndarray, radius: int) -> list[np.ndarray]:
    """Links (2 x n arrays) that join what is within the radius in the group, one fewer than its members at most."""
    out, rest = [], fps
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            one = queue.pop()
            near = np.bitwise_count(rest ^ one) <= radius
            if near.any():
                found = rest[near]
                out.append(np.stack([np.full(len(found), one), found]))
                queue += list(found)
                rest = rest[~near]
    return out


def short_links(fps: np.ndarray, group: np.ndarray, longest: int, radius: int) -> list[np.ndarray]:
    """All links inside groups of a few members, for many groups at once."""
    out = []
    for gap in range(1, longest):
        hit = (group[:-gap] == group[gap:]) & (np.bitwise_count(fps[:-gap] ^ fps[gap:]) <= radius)
        if hit.any():
            out.append(np.stack([fps[:-gap][hit], fps[gap:][hit]]))
    return out


def _links_in_groups(rows: DataFrame, keys: list[str], radius: int, most: int | None) -> DataFrame:
    """Rows (keys, fp) to links (a, b); rows of groups over ``most`` come back with their keys and b null."""
    import pyarrow as pa

    schema = ", ".join(f"{k} long" for k in keys) + ", a long, b long"
    names = [*keys, "a", "b"]
    few = 8

    def emit(links):
        if not links:
            return
        a, b = np.concatenate(links, axis=1).view(np.int64)
        nulls = pa.nulls(len(a), pa.int64())
        yield pa.RecordBatch.from_arrays([*[nulls] * len(keys), pa.array(a), pa.array(b)], names)

    def crowd(key_columns, fps):
        return pa.RecordBatch.from_arrays(
            [*[pa.array(k) for k in key_columns], pa.array(fps.view(np.int64)), pa.nulls(len(fps), pa.int64())], names)

    def make():
        """The rows held are those of the last, perhaps incomplete, group."""
        state = {"held": [np.zeros(0, np.int64) for _ in [*keys, "fp"]], "crowded": None}

        def settle(last):
            held = state["held"]
            fps = held[-1].view(np.uint64)
            if not len(fps):
                return
            edge = np.logical_or.reduce([h[1:] != h[:-1] for h in held[:-1]])
            starts = np.concatenate([[0], np.flatnonzero(edge) + 1])
            stop = len(fps) if last else starts[-1]
            starts = starts[starts < stop]
            sizes = np.diff(np.append(starts, stop))
            group = np.repeat(np.arange(len(sizes)), sizes)
            size_here = np.repeat(sizes, sizes)
            small = size_here <= few
            links = short_links(fps[:stop][small], group[small], min(few, int(sizes.max(initial=0))), radius)
            for at, size in zip(starts[sizes > few], sizes[sizes > few]):
                if most and size > most:
                    yield crowd([h[at:at + size] for h in held[:-1]], fps[at:at + size])
                else:
                    links += forest(fps[at:at + size], radius)
            yield from emit(links)
            state["held"] = [h[stop:] for h in held]

        def run(batches):
            for batch in batches:
                cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
                if state["crowded"] is not None:
                    same = np.logical_and.reduce([c == k for c, k in zip(cols, state["crowded"])])
                    n = len(same) if same.all() else int(np.argmin(same))
                    if n:
                        yield crowd([c[:n] for c in cols[:-1]], cols[-1][:n].view(np.uint64))
                    cols = [c[n:] for c in cols]
                    if not len(cols[-1]):
                        continue
                    state["crowded"] = None
                state["held"] = [np.concatenate([h, c]) for h, c in zip(state["held"], cols)]
                yield from settle(last=False)
                held = state["held"]
                if most and len(held[-1]) > most:
                    yield crowd(held[:-1], held[-1].view(np.uint64))
                    state["crowded"] = [h[0] for h in held[:-1]]
                    state["held"] = [h[:0] for h in held]
            yield from settle(last=True)

        return run

    ordered = rows.select(*keys, "fp").repartition(*keys).sortWithinPartitions(*keys)
    return ordered.mapInArrow(lambda batches: make()(batches), schema)


def _by_masks(rows: DataFrame, table: str, masks: list[int]) -> DataFrame:
    held = [F.struct(F.lit(t).cast("long").alias(table), F.col("fp").bitwiseAND(F.lit(m)).alias("part"))
            for t, m in enumerate(masks)]
    return rows.withColumn("made", F.explode(F.array(*held))).select(*rows.columns, f"made.{table}", "made.part")


def near_links(fps: DataFrame, radius: int = 3, most: int = 4096) -> DataFrame:
    """Links (a, b) that connect all distinct ``fp`` within the radius of one another."""
    first = covering_masks(radius, 1)
    rows = _by_masks(fps.select("fp"), "t", first).withColumnRenamed("part", "m")
    found = stored(_links_in_groups(rows, ["t", "m"], radius, most))
    crowded = found.filter("b is null").select("t", "m", F.col("a").alias("fp"))
    second = _by_masks(crowded, "s", covering_masks(radius, 2)).withColumnRenamed("part", "n")
    again = stored(_links_in_groups(second, ["t", "m", "s", "n"], radius, most))
    keys = ["t", "m", "s", "n"]
    still = again.filter("b is null").select(*keys, F.col("a").alias("fp"))
    blocks = still.groupBy(*keys).agg(F.ceil(F.count("*") / (most // 2)).cast("long").alias("blocks"))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks"))
    dealt = (still.join(blocks, keys).withColumn("own", own)
             .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
             .withColumn("p", F.least("own", "other")).withColumn("q", F.greatest("own", "other")))
    last = _links_in_groups(dealt, [*keys, "p", "q"], radius, None)
    return (found.filter("b is not null").select("a", "b")
            .union(again.filter("b is not null").select("a", "b")).union(last.select("a", "b")).distinct())


def near_duplicates(docs: DataFrame, radius: int = 3, width: int = 3, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) of every row; component_id is the least id reachable over links."""
    rows = stored(fingerprints(docs, width, [F.col(id_col).cast("long").alias("doc_id")], text_col))
    distinct = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(near_links(distinct, radius)).select(F.col("node").alias("fp"), "root")
    labelled = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = labelled.groupBy("root").agg(F.min("first").alias("component_id"))
    return rows.join(labelled.select("fp", "root").join(least, "root").select("fp", "component_id"), "fp").select(
        "doc_id", "fp", "component_id")


def representatives(docs: DataFrame, radius: int = 3, width: int = 3, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """One row of each component, all columns unchanged: the least id's, null ids last, of equal ids one.

    The row to keep is found per fingerprint and then per component on ids and
    row numbers; texts are only joined with the numbers of the rows that stay.
    """
    numbered = docs.withColumn("_row", F.monotonically_increasing_id())
    held = stored(numbered)
    rows = stored(fingerprints(held, width, ["_row", F.col(id_col).cast("long").alias("doc_id")], text_col))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "_row"))
    distinct = stored(rows.groupBy("fp").agg(first.alias("first")))
    roots = components(near_links(distinct.select("fp"), radius)).select(F.col("node").alias("fp"), "root")
    kept = (distinct.join(roots, "fp", "left").groupBy(F.coalesce("root", "fp").alias("root"))
            .agg(F.min("first").alias("first")).select(F.col("first._row").alias("_row")))
    return held.join(kept, "_row", "left_semi").select(*docs.columns)
