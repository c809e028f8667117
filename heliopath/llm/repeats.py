"""Repeated windows of bytes by a depth-limited radix sort of the suffixes, most significant digit first.

Suffixes are ordered only through ``depth`` bytes; those still together after
the last digit are exactly the windows that start more than once. The digits:

1. *Anchor.* The anchor of a window is its leftmost gram of ``GRAM`` bytes with
   the least hash, so equal windows have the same anchor at the same place. Suffixes
   next to each other mostly share one and travel as one row. Anchors whose
   gram occurs once leave: only counts per gram are shuffled.
2. *Extent.* Rows whose whole range of suffixes is equal byte for byte are equal
   in every digit and need no more passes; one of them stays as partner for the rest of its gram.
3. *Bytes.* Suffixes of one gram that are still open are cut by their place
   before the gram and then by eight bytes at a time, single ones leaving after
   each pass. A gram with more than ``MOST`` open rows is not sorted in one task: its suffixes take the
   rest of their depth as one digit, a 128-bit hash counted over the cluster.

Grams and extents are told apart by hashes of 64 bits each, together 128. Texts
are read by anchors of ``CHUNK`` bytes at a time, so one of any length is worked off in pieces.
Equal texts are one node from the start; a text found twice repeats whole.
The nodes' texts are shuffled once, into buckets, and joined there with what belongs to them.

A null text is empty. Texts of fewer bytes than ``depth`` have no window and
stay whole. An empty table gives an empty result. Ids are carried, not read.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import parts_of, stored, texts_of, work_dir

GRAM, CHUNK, MOST, OPEN = 40, 1 << 19, 10_000, 10_000
PLACE = np.uint64((1 << 20) - 1)
ODD, BASE = np.uint64(0x9E3779B97F4A7C15), 0xD6E8FEB86659FD93
WORLD = 1 << 64


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * ODD
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


class Hasher:
    """Hashes of any byte range of a buffer, by prefix sums modulo 2^64 over two random values per byte value."""

    def __init__(self, most: int):
        rng = np.random.default_rng(20)
        self.values = rng.integers(0, 1 << 63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.power = self._powers(BASE, most)
        self.inverse = self._powers(pow(BASE, -1, WORLD), most)

    @staticmethod
    def _powers(base: int, n: int) -> np.ndarray:
        out = np.ones(1, np.uint64)
        while len(out) < n:
            out = np.concatenate([out, out * np.uint64(pow(base, len(out), WORLD))])
        return out[:n]

    def sums(self, data: np.ndarray, which: int) -> np.ndarray:
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.values[which][data] * self.power[:len(data)])])

    def between(self, sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((sums[end] - sums[begin]) * self.inverse[begin])


def least_behind(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` consecutive values."""
    have = 1
    while have * 2 <= width:
        values = np.minimum(values[:-have], values[have:])
        have *= 2
    return np.minimum(values[:len(values) - (width - have)], values[width - have:]) if width > have else values


def anchors(hasher: Hasher, data: np.ndarray, starts: np.ndarray, gram: int, depth: int):
    """Suffixes (marked in ``starts``) by anchor: arrays gram, extent, first suffix, anchor's place in it, suffixes less one."""
    if len(data) < depth or not starts.any():
        return [np.zeros(0, np.uint64)] * 2 + [np.zeros(0, np.int64)] * 3
    sums = [hasher.sums(data, which) for which in (0, 1)]
    at = np.arange(len(data) - gram + 1)
    grams = hasher.between(sums[0], at, at + gram)
    order = (mixed(grams) & ~PLACE) | at.astype(np.uint64)
    place = (least_behind(order, depth - gram + 1) & PLACE).astype(np.int64)
    own = np.flatnonzero(starts)
    place = place[own]
    edge = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (own[1:] != own[:-1] + 1)]))
    first, anchor = own[edge], place[edge]
    more = np.diff(np.append(edge, len(own))) - 1
    shape = ((anchor - first) << 16 | more).astype(np.uint64)
    extent = hasher.between(sums[1], first, first + more + depth)
    return [grams[anchor], mixed(extent ^ shape * ODD), first, anchor - first, more]


def pieces(texts: list[bytes], depth: int):
    """Buffers of texts: (bytes, marks of suffixes to take, index of the text of each, byte of its text of each).

    A longer text is cut into pieces that overlap by a suffix less one.
    """
    held, size = [], 0
    for i, text in enumerate(texts):
        for at in range(0, max(0, len(text) - depth + 1), CHUNK):
            piece = text[at:at + CHUNK + depth - 1]
            if size + len(piece) > CHUNK + depth and held:
                yield _joined(held, depth)
                held, size = [], 0
            held.append((i, at, piece))
            size += len(piece)
    if held:
        yield _joined(held, depth)


def _joined(held, depth):
    data = np.frombuffer(b"".join(p for _, _, p in held), np.uint8)
    sizes = np.array([len(p) for _, _, p in held])
    ends = np.cumsum(sizes)
    starts = np.ones(len(data), bool)
    for e in ends.tolist():
        starts[e - depth + 1:e] = False
    return data, starts, np.repeat([i for i, _, _ in held], sizes), np.arange(len(data)) + np.repeat([a for _, a, _ in held] - (ends - sizes), sizes)


def repeated_suffixes(texts: np.ndarray, first: np.ndarray, group: np.ndarray, digits: int, last: int) -> np.ndarray:
    """Marks the suffixes that are equal to another of their group through the depth.

    ``texts`` is one byte buffer, ``first`` a suffix's place in it. Every pass cuts the groups by eight bytes, the
    last by ``last`` of them; a suffix alone in its group leaves.
    """
    live, weights = np.arange(len(first)), 256 ** np.arange(7, -1, -1, dtype=np.uint64)
    words = np.zeros(len(texts), np.uint64)
    for k, weight in enumerate(weights):
        words[:len(texts) - k] += texts[k:].astype(np.uint64) * weight
    # Beyond the buffer's end a digit reads zeros, which no suffix of whole depth does.
    for digit in range(-1, digits):
        if digit >= 0:
            value = words[first[live] + 8 * digit]
            if digit == digits - 1 and last < 8:
                value = value >> np.uint64(64 - 8 * last)
            order = np.lexsort((value, group[live]))
        else:
            value, order = np.zeros(len(live), np.uint64), np.argsort(group, kind="stable")
        live, value = live[order], value[order]
        own = group[live]
        new = np.concatenate([[True], (own[1:] != own[:-1]) | (value[1:] != value[:-1])])[:len(live)]
        number = np.cumsum(new)
        several = np.bincount(number)[number] > 1
        group = group.copy()
        group[live] = number
        live = live[several]
        if not len(live):
            break
    marks = np.zeros(len(first), bool)
    marks[live] = True
    return marks


def runs(marks: np.ndarray, row: np.ndarray, at: np.ndarray, depth: int):
    """Marked suffixes, in order of row and place, as (row, begin, end) of the bytes that they cover."""
    hit = np.flatnonzero(marks)
    if not len(hit):
        return hit, hit, hit
    edge = np.flatnonzero(np.concatenate([[True], (row[hit][1:] != row[hit][:-1]) | (at[hit][1:] != at[hit][:-1] + 1)]))
    ends = np.append(edge[1:], len(hit)) - 1
    return row[hit][edge], at[hit][edge], at[hit][ends] + depth


class Repeats:
    """The passes over one table of nodes (key, copies, text), bucketed by key."""

    def __init__(self, docs: DataFrame, depth: int, text_col: str):
        if depth <= GRAM or depth > 1 << 15:
            raise ValueError(f"depth must be over {GRAM} and no more than {1 << 15}")
        self.depth, spark = depth, docs.sparkSession
        text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
        nodes = docs.select(F.unhex(F.md5(text)).alias("key"), text.alias("text")).groupBy("key").agg(
            F.first("text").alias("text"), F.count("*").alias("copies"))
        name = f"repeats_{uuid.uuid4().hex}"
        buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        (nodes.write.bucketBy(buckets, "key").option("path", f"{work_dir(spark)}/nodes").option("compression", "zstd")
         .saveAsTable(name))
        self.nodes = spark.table(name)

    def rows(self, counted: bool) -> DataFrame:
        """Anchor rows of the nodes: (gram, extent, n) or, to be joined, also key, first and shape.

        Rows of one gram and extent within a batch are told at once: (key, begin, end) without a gram for all of
        them and one row of n 2 that stands for them.
        """
        import pyarrow as pa

        depth, gram = self.depth, GRAM
        fields = "gram long, extent long, n long" + ("" if counted else ", key binary, first long, shape long, begin long, end long")
        names = [f.split()[0] for f in fields.split(", ")]

        def work(batches):
            hasher = Hasher(CHUNK + 2 * depth)
            for batch in batches:
                for part in parts_of(batch):
                    keys = part.column(0)
                    for data, starts, text_no, byte in pieces(texts_of(part.column(1)), depth):
                        g, e, first, offset, more = anchors(hasher, data, starts, gram, depth)
                        if not len(g):
                            continue
                        order = np.lexsort((e, g))
                        new = np.concatenate([[True], (g[order][1:] != g[order][:-1]) | (e[order][1:] != e[order][:-1])])
                        count = np.diff(np.append(np.flatnonzero(new), len(g)))
                        stands = order[new]
                        base = [pa.array(x.view(np.int64)) for x in (g[stands], e[stands], np.minimum(count, 2))]
                        if counted:
                            yield pa.RecordBatch.from_arrays(base, names)
                            continue
                        none = pa.nulls(len(stands), pa.int64())
                        yield pa.RecordBatch.from_arrays(
                            [*base, keys.take(pa.array(text_no[first[stands]])), pa.array(byte[first[stands]]),
                             pa.array(offset[stands] << 16 | more[stands]), none, none], names)
                        again = np.sort(order[np.repeat(count > 1, count)])
                        if not len(again):
                            continue
                        begin, end, owner = first[again], first[again] + more[again] + depth, text_no[first[again]]
                        cut = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (begin[1:] > end[:-1])]))
                        to = end[np.append(cut[1:], len(again)) - 1]
                        shift = byte[begin[cut]] - begin[cut]
                        none = pa.nulls(len(cut), pa.int64())
                        yield pa.RecordBatch.from_arrays(
                            [none, none, none, keys.take(pa.array(owner[cut])), none, none,
                             pa.array(begin[cut] + shift), pa.array(to + shift)], names)

        return self.nodes.select("key", "text").mapInArrow(work, fields)

    def spans(self) -> DataFrame:
        """(key, spans) of every node with a repeated window besides itself; spans overlap and have no order."""
        depth = self.depth
        live = stored(self.rows(True).groupBy("gram").agg(F.sum("n").alias("n"), F.min("extent").alias("low"), F.max("extent").alias("high"))
                      .filter("n > 1").select("gram", (F.col("low") != F.col("high")).alias("split")))
        rows = self.rows(False)
        known = stored(rows.join(live, "gram", "left").filter("gram is null or split is not null"))
        told = known.filter("gram is null").select("key", "begin", "end")
        held = known.filter("gram is not null").drop("begin", "end")
        end = F.col("first") + F.col("shape").bitwiseAND(0xFFFF) + depth
        alike = held.filter("not split").select("key", F.col("first").alias("begin"), end.alias("end"))
        classes = stored(held.filter("split").groupBy("gram", "extent").agg(
            F.sum("n").alias("n"), F.min(F.struct("key", "first", "shape")).alias("one")))
        several = classes.filter("n > 1").select("gram", "extent")
        same = (held.filter("split").join(several, ["gram", "extent"], "left_semi")
                .select("key", F.col("first").alias("begin"), end.alias("end")))
        # A gram whose extents all occur several times is settled.
        open_grams = classes.groupBy("gram").agg(F.count("*").alias("members"), F.min("n").alias("least")).filter("least = 1")
        partners = classes.join(open_grams.drop("least"), "gram").select(
            F.col("one.key").alias("key"),
            F.struct("gram", "members", (F.col("n") == 1).alias("single"), F.col("one.first").alias("first"), F.col("one.shape").alias("shape")).alias("part"))
        texts = self._contexts(partners.groupBy("key").agg(F.collect_list("part").alias("parts")))
        found = self._sorted(texts.filter(F.col("members") <= MOST)).union(self._counted(texts.filter(F.col("members") > MOST)))
        return told.union(alike).union(same).union(found).groupBy("key").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))

    def _contexts(self, parts: DataFrame) -> DataFrame:
        """The bytes of every open extent, taken from the nodes' texts."""
        import pyarrow as pa

        depth = self.depth
        fields = "gram long, members long, single boolean, key binary, first long, shape long, held binary"
        names = [f.split()[0] for f in fields.split(", ")]

        def work(batches):
            for batch in batches:
                for part in parts_of(batch):
                    texts = texts_of(part.column(1))
                    lists = part.column(2)
                    owner = lists.value_parent_indices().to_numpy()
                    flat = lists.flatten()
                    first, shape = (flat.field(c).to_numpy() for c in ("first", "shape"))
                    ends = first + (shape & 0xFFFF) + depth
                    held = pa.array([texts[o][b:e] for o, b, e in zip(owner.tolist(), first.tolist(), ends.tolist())], pa.binary())
                    yield pa.RecordBatch.from_arrays(
                        [flat.field("gram"), flat.field("members"), flat.field("single"), part.column(0).take(pa.array(owner)),
                         flat.field("first"), flat.field("shape"), held], names)

        return stored(self.nodes.join(parts, "key").select("key", "text", "parts").mapInArrow(work, fields))

    def _sorted(self, texts: DataFrame) -> DataFrame:
        """(key, begin, end) of the repeated windows of single extents, by passes of eight bytes in a gram's task."""
        import pyarrow as pa

        depth = self.depth
        names = ["key", "begin", "end"]

        def settle(batch):
            gram, first, shape = (batch.column(c).to_numpy() for c in ("gram", "first", "shape"))
            held = batch.column("held").to_pylist()
            lengths = np.fromiter(map(len, held), np.int64, len(held))
            data = np.frombuffer(b"".join(held), np.uint8)
            base = np.cumsum(lengths) - lengths
            count = (shape & 0xFFFF) + 1
            row = np.repeat(np.arange(len(gram)), count)
            step = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            before = (shape >> 16)[row] - step  # bytes between the suffix and its anchor
            number = np.cumsum(np.concatenate([[0], gram[1:] != gram[:-1]]))
            group = number[row] * (1 << 16) + before
            marks = repeated_suffixes(data, base[row] + step, group, -(-depth // 8), (depth - 1) % 8 + 1)
            marks &= batch.column("single").to_numpy(zero_copy_only=False)[row]
            rows, begin, to = runs(marks, row, first[row] + step, depth)
            return pa.RecordBatch.from_arrays([pa.array(batch.column("key").take(pa.array(rows)).to_pylist(), pa.binary()),
                                               pa.array(begin), pa.array(to)], names)

        def work(batches):
            held = None
            for batch in batches:
                held = pa.Table.from_batches(([] if held is None else held.to_batches()) + [batch])
                if len(held) < OPEN:
                    continue
                gram = held.column("gram").to_numpy()
                cut = np.flatnonzero(gram[1:] != gram[:-1]) + 1
                at = 0
                for to in [*cut[np.searchsorted(cut, np.arange(OPEN, len(gram), OPEN), "left") - 1].tolist()] if len(cut) else []:
                    if to > at:
                        yield settle(held.slice(at, to - at).combine_chunks().to_batches()[0])
                        at = to
                if len(cut) and cut[-1] > at:
                    yield settle(held.slice(at, cut[-1] - at).combine_chunks().to_batches()[0])
                    at = int(cut[-1])
                held = held.slice(at)
            if held is not None and len(held):
                yield settle(held.combine_chunks().to_batches()[0])

        ordered = texts.repartition("gram").sortWithinPartitions("gram")
        return ordered.mapInArrow(work, "key binary, begin long, end long")

    def _counted(self, texts: DataFrame) -> DataFrame:
        """The same for grams with many open extents: each suffix's whole depth as one digit."""
        import pyarrow as pa

        depth = self.depth

        def work(batches):
            hasher = Hasher(1 << 20)
            for batch in batches:
                for at in range(0, batch.num_rows, 500):
                    part = batch.slice(at, 500)
                    held = part.column(6).to_pylist()
                    lengths = np.fromiter(map(len, held), np.int64, len(held))
                    data, base = np.frombuffer(b"".join(held), np.uint8), np.cumsum(lengths) - lengths
                    if len(data) > len(hasher.power):
                        hasher = Hasher(len(data))
                    count = (part.column(5).to_numpy() & 0xFFFF) + 1
                    row = np.repeat(np.arange(len(held)), count)
                    step = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                    begin = base[row] + step
                    hashes = [hasher.between(hasher.sums(data, w), begin, begin + depth).view(np.int64) for w in (0, 1)]
                    yield pa.RecordBatch.from_arrays(
                        [*map(pa.array, hashes), pa.array(part.column(3).take(pa.array(row)).to_pylist(), pa.binary()),
                         part.column(2).take(pa.array(row)), pa.array(part.column(4).to_numpy()[row] + step)],
                        ["one", "two", "key", "single", "begin"])

        suffixes = texts.mapInArrow(work, "one long, two long, key binary, single boolean, begin long")
        several = suffixes.groupBy("one", "two").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
        return (suffixes.filter("single").join(several, ["one", "two"], "left_semi")
                .select("key", "begin", (F.col("begin") + depth).alias("end")))

    def cut(self) -> DataFrame:
        """(key, n_bytes, spans, kept) of every node: the maximal covered runs and the remaining bytes in order."""
        import pyarrow as pa

        depth = self.depth
        names = ["key", "n_bytes", "spans", "kept"]
        span = pa.struct([("begin", pa.int64()), ("end", pa.int64())])

        def merged(found):
            out = []
            for begin, end in sorted(found):
                if out and begin <= out[-1][1]:
                    out[-1][1] = max(out[-1][1], end)
                else:
                    out.append([begin, end])
            return out

        def work(batches):
            for batch in batches:
                for part in parts_of(batch):
                    texts, all_spans, kept = texts_of(part.column(1)), [], []
                    for text, copies, found in zip(texts, part.column(2).to_pylist(), part.column(3).to_pylist()):
                        if copies > 1 and len(text) >= depth:
                            own = [[0, len(text)]]
                        else:
                            own = merged([(s["begin"], s["end"]) for s in found or ()])
                        edges = [0, *[x for s in own for x in s], len(text)]
                        kept.append(b"".join(text[edges[i]:edges[i + 1]] for i in range(0, len(edges), 2)))
                        all_spans.append([{"begin": b, "end": e} for b, e in own])
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(all_spans, pa.list_(span)),
                         pa.array(kept, pa.binary())], names)

        rows = self.nodes.join(self.spans(), "key", "left").select("key", "text", "copies", "spans")
        return rows.mapInArrow(work, "key binary, n_bytes long, spans array<struct<begin:long,end:long>>, kept binary")


def text_key(text_col: str = "text"):
    """The key under which a text's cut is found."""
    return F.unhex(F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))


def cut_texts(docs: DataFrame, depth: int = 200, text_col: str = "text") -> DataFrame:
    """(key, n_bytes, spans, kept) of every different text: byte runs covered by repeated windows, and the rest.

    Join it to the rows by ``text_key``.
    """
    return Repeats(docs, depth, text_col).cut()
