"""Near copies: candidates by SimHash within a radius, links by the exact Jaccard similarity of word shingles.

Two fingerprints at most ``radius`` bits apart differ in at most half as many
in one of their two 32-bit halves, so covering masks are dealt out per half:
127 tables a half for radius 13. Every position of a half gets a vector whose
last bit is one; the other masks than the full one then read 12, 16 or 20 bits.

Texts of the same words are one node. A pair is a candidate if it meets in a
bucket within the radius and its shingle counts allow the similarity. A bucket with more
than ``DENSE`` such pairs for each member gives a forest of them, grown from the
nodes of least hash. A node is compared with the ``HUBS`` partners of least hash; nodes with more, or in a bucket
with too many, are *dense*. Once the
candidates are compared and joined, dense nodes that are still apart meet again on a
prefix of their shingles, rare ones first: texts as similar share one at places
that leave room for the overlap (prefix and positional filter, nothing is lost). Where they meet, texts of ``SETS`` shingles
at most are compared by the hashes that travel with them, and of the links found a forest is given, so a group of k
gives k - 1 pairs at most; of longer texts all pairs that may be as similar are given. So every pair
within the radius and as similar is compared or joined by links, and
texts that only look alike by their fingerprint are not all paired.

Similarity counts distinct shingles of ``width`` words; a text of fewer words
is one shingle. A pair of similarity s is within 13 bits with a chance that falls with s,
so links near the least similarity are missed; the README has measured shares.

A null text counts as empty; all empty texts are one group. Rows of a null id
are like others and stay only if their group has no other id. An empty table gives an
empty result. Columns are not renamed or added on the way, so their names may be any.
"""

from __future__ import annotations

import math
import random
from hashlib import md5

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .covering import fingerprint
from .tables import let_go, parts_of, starts_of, stored, texts_of

HALF, FEW, DENSE, HUBS = 32, 16, 8, 8
PART_BYTES = 2_000_000
TOKEN_ROWS = 5_000
SETS = 512  # texts of more shingles do not take all of them to every shingle of their prefix
SLOTS = 1 << 18  # counters of the shingle sketch
LOG_STEP, LOG_SHIFT = 100, 50
MIX = np.uint64(0x9E3779B97F4A7C15)


def half_masks(radius: int) -> list[int]:
    """Masks so that any two fingerprints within the radius agree on one of them at least."""
    bits = radius // 2
    if bits > 6:
        raise ValueError("radius must be 13 or less")
    place = random.Random(5).sample(range(HALF), HALF)
    # A sixth bit is a quadratic form of the five, so that no mask is left with fewer than 12 positions.
    form = [(p & 1) * (p >> 1 & 1) ^ (p >> 2 & 1) * (p >> 3 & 1) for p in place]
    vector = [1 << bits | (p | f << 5) % (1 << bits) for p, f in zip(place, form)]
    return [sum(1 << half + i for i in range(HALF) if (vector[i] & v).bit_count() & 1)
            for half in (0, HALF) for v in range(1, 2 << bits)]


def shingles(data: bytes, width: int) -> set[bytes]:
    words = data.lower().split()
    return {b" ".join(words[i:i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def mixed(values: np.ndarray) -> np.ndarray:
    h = values.view(np.uint64) * MIX
    return (h ^ (h >> np.uint64(29))) * MIX


class Close:
    """Which nodes of a bucket may be near copies: within the radius and of fitting shingle counts."""

    def __init__(self, radius: int, similarity: float):
        # A node's number begins with the logarithm of its count, rounded down: this far apart at most.
        self.radius, self.most = radius, math.floor(-math.log(similarity) * LOG_STEP) + 1

    def __call__(self, fps, nodes, one_fp, one_node) -> np.ndarray:
        near = np.bitwise_count(fps ^ one_fp) <= self.radius
        return near & (np.abs((nodes >> LOG_SHIFT) - (one_node >> LOG_SHIFT)) <= self.most)


def close_pairs(fps: np.ndarray, nodes: np.ndarray, close: Close, most: float) -> np.ndarray | None:
    """Index pairs (2 x n) of what is close; None if there are more than ``most``."""
    out, n = [np.zeros((2, 0), np.int64)], 0
    for i in range(len(fps) - 1):
        found = i + 1 + np.flatnonzero(close(fps[i + 1:], nodes[i + 1:], fps[i], nodes[i]))
        n += len(found)
        if n > most:
            return None
        if len(found):
            out.append(np.stack([np.full(len(found), i), found]))
    return np.concatenate(out, axis=1)


def forest_pairs(fps: np.ndarray, nodes: np.ndarray, close: Close) -> np.ndarray:
    """Index pairs of a forest over what is close: each tree grows from its node of least hash."""
    out, rest = [np.zeros((2, 0), np.int64)], np.argsort(mixed(nodes), kind="stable")
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            one = queue.pop(0)
            near = close(fps[rest], nodes[rest], fps[one], nodes[one])
            found, rest = rest[near], rest[~near]
            queue += found.tolist()
            out.append(np.stack([np.full(len(found), one), found]))
    return np.concatenate(out, axis=1)


def runs_of(batches):
    """The columns of batches sorted by the first as numpy arrays, cut where its value changes."""
    held = None
    for batch in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        held = cols if held is None else [np.concatenate([h, c]) for h, c in zip(held, cols)]
        edge = np.flatnonzero(held[0][1:] != held[0][:-1])
        if len(edge):
            yield [h[:edge[-1] + 1] for h in held]
            held = [h[edge[-1] + 1:] for h in held]
    if held is not None and len(held[0]):
        yield held


def _pair_batches(a: np.ndarray, b: np.ndarray, each: int = 100_000):
    import pyarrow as pa

    for at in range(0, len(a), each):
        yield pa.RecordBatch.from_arrays([pa.array(a[at:at + each]), pa.array(b[at:at + each])], ["a", "b"])


def _in_order(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _candidates(dealt: DataFrame, close: Close) -> DataFrame:
    """Rows (bucket, fp, node) to pairs (a, b, dense), dense if their bucket is."""
    import pyarrow as pa

    def marked(batches, dense):
        for batch in batches:
            yield batch.append_column("dense", pa.array([dense] * batch.num_rows, pa.bool_()))

    def work(batches):
        let_go()
        for bucket, fp, node in runs_of(batches):
            fps = fp.view(np.uint64)
            starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            sizes = np.diff(np.append(starts, len(bucket)))
            index = np.flatnonzero(np.repeat(sizes <= FEW, sizes))
            for gap in range(1, int(sizes[sizes <= FEW].max(initial=1))):
                a, b = index[:-gap], index[gap:]
                hit = bucket[a] == bucket[b]
                a, b = a[hit], b[hit]
                hit = close(fps[a], node[a], fps[b], node[b])
                yield from marked(_pair_batches(node[a[hit]], node[b[hit]]), False)
            for at, size in zip(starts[sizes > FEW].tolist(), sizes[sizes > FEW].tolist()):
                own = slice(at, at + size)
                pairs = close_pairs(fps[own], node[own], close, DENSE * size)
                dense = pairs is None
                hubs, members = node[own][forest_pairs(fps[own], node[own], close) if dense else pairs]
                yield from marked(_pair_batches(members, hubs), dense)

    ordered = dealt.select("bucket", "fp", "node").repartition("bucket").sortWithinPartitions("bucket")
    return ordered.mapInArrow(work, "a long, b long, dense boolean").distinct()


def similar(pairs: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of nodes whose texts (node, text) are as similar."""
    import pyarrow as pa

    both = (pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("left_text")), "a")
            .join(texts.select(F.col("node").alias("b"), F.col("text").alias("right_text")), "b")
            .select("a", "b", "left_text", "right_text"))

    def compare(batches):
        for batch in batches:
            for part in parts_of(batch, PART_BYTES, 2):
                keep, last, own = [], None, set()
                for a, x, y in zip(part.column(0).to_pylist(), texts_of(part.column(2)), texts_of(part.column(3))):
                    if a != last:
                        last, own = a, shingles(x, width)
                    other = shingles(y, width)
                    common = len(own & other)
                    keep.append(common / max(1, len(own) + len(other) - common) >= similarity)
                yield pa.RecordBatch.from_arrays(part.columns[:2], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(compare, "a long, b long")


def _hashes(data: bytes, width: int) -> np.ndarray:
    from xxhash import xxh64_intdigest

    own = shingles(data, width)
    return np.fromiter(map(xxh64_intdigest, own), np.uint64, len(own))


def sketch(texts: DataFrame, width: int) -> np.ndarray:
    """About how often each shingle's slot occurs: one counter per slot, whatever the number of texts."""
    import pyarrow as pa

    def count(batches):
        own = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for data in texts_of(batch.column(0)):
                own += np.bincount((_hashes(data, width) % np.uint64(SLOTS)).astype(np.int64), minlength=SLOTS)
        at = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(own[at])], ["slot", "n"])

    counts = np.zeros(SLOTS, np.int64)
    for slot, n in texts.select("text").mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n")).collect():
        counts[slot] = n
    return counts


def prefix_pairs(dense: DataFrame, close: Close, width: int, similarity: float) -> DataFrame:
    """Pairs (a, b) of rows (node, fp, root, text) of different roots that join all that are as similar, by their prefixes.

    Shingles are in one order for all, rare ones first. A pair of similarity s and n and m shingles shares at least
    s / (1 + s) * (n + m), so the first that it shares is at places with as many behind. Nodes already joined, by their
    roots or by pairs given before, are not joined again at the same shingle.
    """
    import pyarrow as pa

    counts = dense.sparkSession.sparkContext.broadcast(sketch(dense, width))
    names = ["token", "node", "fp", "root", "n", "at", "held"]

    def first_shingles(batches):
        for batch in batches:
            for part in parts_of(batch, PART_BYTES, 3):
                rows, held = [], []
                for i, data in enumerate(texts_of(part.column(3))):
                    own = _hashes(data, width)
                    n = len(own)
                    held.append(own.tobytes() if n <= SETS else None)
                    own = own[np.lexsort((own, counts.value[(own % np.uint64(SLOTS)).astype(np.int64)]))]
                    kept = own[:n - math.ceil(similarity * n - 1e-9) + 1]
                    rows.append((kept.view(np.int64), np.full(len(kept), i), np.full(len(kept), n), np.arange(len(kept))))
                token, row, n, at = (np.concatenate(c) for c in zip(*rows)) if rows else [np.zeros(0, np.int64)] * 4
                node, fp, root = (part.column(k).to_numpy()[row] for k in range(3))
                for to in range(0, len(row), TOKEN_ROWS):
                    some = slice(to, to + TOKEN_ROWS)
                    yield pa.RecordBatch.from_arrays([*[pa.array(c[some]) for c in (token, node, fp, root, n, at)],
                                                      pa.array([held[i] for i in row[some].tolist()], pa.binary())], names)

    share = similarity / (1 + similarity)

    def meet(batches):
        for token, node, fp, root, n, at, held in runs_of(batches):
            starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            fps, room, out = fp.view(np.uint64), n - at, [np.zeros((2, 0), np.int64)]
            for begin, end in zip(starts.tolist(), np.append(starts[1:], len(token)).tolist()):
                tree = root[begin:end].copy()
                for i in range(begin, end - 1):
                    rest = slice(i + 1, end)
                    enough = np.minimum(room[rest], room[i]) >= share * (n[rest] + n[i]) - 1e-9
                    apart = tree[i + 1 - begin:] != tree[i - begin]
                    hit = i + 1 + np.flatnonzero(enough & apart & close(fps[rest], node[rest], fps[i], node[i]))
                    told = (n[hit] <= SETS) & (n[i] <= SETS)
                    short = hit[told]
                    if len(short):
                        sets = np.frombuffer(b"".join(held[short].tolist()), np.uint64)
                        common = np.add.reduceat(np.isin(sets, np.frombuffer(held[i], np.uint64)).astype(np.int64), starts_of(n[short])[:-1])
                        short = short[common >= share * (n[short] + n[i]) - 1e-9]
                        # One link to each tree; from here on they are one.
                        others, first = np.unique(tree[short - begin], return_index=True)
                        short = short[first]
                        tree[np.isin(tree, others)] = tree[i - begin]
                    linked = np.concatenate([short, hit[~told]])
                    out.append(np.stack([np.full(len(linked), node[i]), node[linked]]))
                if len(out) > 10_000:
                    yield from _pair_batches(*np.concatenate(out, axis=1))
                    out = [np.zeros((2, 0), np.int64)]
            yield from _pair_batches(*np.concatenate(out, axis=1))

    rows = dense.select("node", "fp", "root", "text").mapInArrow(first_shingles, ", ".join(f"{c} long" for c in names[:-1]) + ", held binary")
    return rows.repartition("token").sortWithinPartitions("token").mapInArrow(meet, "a long, b long")


def _nodes(rows: DataFrame, width: int) -> DataFrame:
    """(key, fp, size, doc_id, mark, tag) of rows (doc_id, mark, tag, text); key is a hash of the text's words."""
    import pyarrow as pa

    def hashed(batches):
        let_go()
        for batch in batches:
            for part in parts_of(batch, PART_BYTES, 3):
                datas = texts_of(part.column(3))
                keys = [md5(b" ".join(d.lower().split())).digest() for d in datas]
                fps = np.fromiter((fingerprint(d, width) for d in datas), np.uint64, len(datas))
                sizes = [len(shingles(d, width)) for d in datas]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.binary()), pa.array(fps.view(np.int64)), pa.array(sizes, pa.int64()), *part.columns[:3]],
                    ["key", "fp", "size", "doc_id", "mark", "tag"])

    return rows.mapInArrow(hashed, "key binary, fp long, size long, doc_id long, mark binary, tag long")


def node_links(nodes: DataFrame, texts: DataFrame, radius: int, width: int, similarity: float) -> DataFrame:
    """(node, root) of all linked nodes (node, fp, mark), whose texts are those of (mark, text)."""
    whole = (1 << HALF) - 1
    # The table's number and the half of the masked fingerprint that is not zero in one long.
    made = []
    for t, mask in enumerate(half_masks(radius)):
        part = F.col("fp").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))
        part = F.shiftrightunsigned(part, HALF) if mask > whole else part
        made.append(part.bitwiseOR(F.lit(t << HALF)))
    close = Close(radius, similarity)
    found = stored(_candidates(nodes.select("fp", "node", F.explode(F.array(*made)).alias("bucket")), close))
    ends = found.select("a", "b", "dense").union(found.select("b", "a", "dense")).groupBy("a", "b").agg(F.max("dense").alias("dense"))
    ends = stored(ends)
    # A node's partners of least hash are compared, all if there are few. A pair left out so has two dense ends.
    near = F.row_number().over(Window.partitionBy("a").orderBy(F.xxhash64("b"), "b"))
    pairs = stored(_in_order(ends.select("a", "b").withColumn("place", near).filter(F.col("place") <= HUBS)))
    dense = stored(ends.groupBy("a").agg(F.count("*").alias("n"), F.max("dense").alias("dense"))
                   .filter(F.col("dense") | (F.col("n") > HUBS)).select(F.col("a").alias("node")))
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).union(dense).distinct()
    marks = nodes.join(ends, "node").select("node", "mark")
    held = stored(texts.join(marks, "mark").dropDuplicates(["node"]).select("node", "text"))
    links = stored(similar(pairs, held, width, similarity))
    roots = components(links)
    if dense.isEmpty():
        return roots
    apart = (dense.join(nodes.select("node", "fp"), "node").join(roots, "node", "left").join(held, "node")
             .select("node", "fp", F.coalesce("root", "node").alias("root"), "text"))
    more = similar(stored(_in_order(prefix_pairs(stored(apart), close, width, similarity))), held, width, similarity)
    return components(stored(links.union(more)))


def without_near_copies(docs: DataFrame, radius: int = 13, width: int = 5, similarity: float = 0.8, id_col: str = "doc_id",
                        text_col: str = "text") -> DataFrame:
    """One row of each group of linked texts, all columns unchanged: the least id's, null ids last, of equal ids one."""
    mark = F.unhex(F.md5(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))))
    plain = [F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()]
    own = F.struct(F.col(f"`{id_col}`").cast("long").alias("doc_id"), mark.alias("mark"), F.xxhash64(*plain).alias("tag"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), own.alias("own"))
    texts = docs.select(mark.alias("mark"), F.col(f"`{text_col}`").alias("text"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "mark", "tag"))
    q = F.floor(F.log(F.greatest("size", F.lit(1))) * LOG_STEP).cast("long")
    nodes = (_nodes(docs.select(own.alias("own"), F.col(f"`{text_col}`").alias("text")).select("own.*", "text"), width)
             .groupBy("key").agg(first.alias("first"), F.first("fp").alias("fp"), F.first("size").alias("size")))
    nodes = stored(nodes.select((F.shiftleft(q, LOG_SHIFT) + F.monotonically_increasing_id()).alias("node"), "fp", "first",
                                F.col("first.mark").alias("mark")))
    roots = node_links(nodes.select("node", "fp", "mark"), texts, radius, width, similarity)
    kept = (nodes.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root"))
            .agg(F.min("first").alias("first")))
    winners = kept.select(F.struct("first.doc_id", "first.mark", "first.tag").alias("winner"))
    # Rows alike in all columns cannot be told apart: of those that win, one is taken by a count on their hashes.
    alike = rows.groupBy("own").agg(F.count("*").alias("n")).filter("n > 1").select("own")
    same = lambda a, b: (F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.mark") == F.col(f"{b}.mark"))
                         & (F.col(f"{a}.tag") == F.col(f"{b}.tag")))
    won = rows.join(winners, same("own", "winner"), "left_semi")
    several = alike.select(F.col("own").alias("other"))
    once = won.join(several, same("own", "other"), "left_anti")
    twice = won.join(several, same("own", "other"), "left_semi").dropDuplicates(["own"])
    return once.union(twice).select("row.*")
