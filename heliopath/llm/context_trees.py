"""Language-model scores by context-tree weighting over bytes.

A text is the lower-cased words with single blanks between them and an end
byte. Every byte is eight binary decisions; each of the 255 decision nodes has
a context tree over the preceding ``depth`` bytes. A node of the tree at
depth d has the zeros and ones seen after its context; its Krichevsky-Trofimov
probability Pe of them is mixed with the product over its children:
Pw = Pe / 2 + (product of the children's Pw) / 2, Pw = Pe at full depth. Given the
trained trees, a decision's probability is the mixture over all depths along
its context with the weights Pe / (2 Pw); a path ends at the deepest context
that training has seen. The sum of the logarithms is the score, and its
negative in bits per byte the code length.

How it is spread: tasks gather blocks of texts and emit, per block, the
distinct words and (depth + 1)-grams with their training counts, as arrays
dealt out by key hash. Parts merge the arrays of all blocks; trees are built
where the grams that share their last two context bytes meet, each distinct gram once, and only the
sums of depth two (at most 65,536 rows) meet in the driver for depths one and
zero. Each block then gets the values of its own keys back and scores its
texts. No text is compared with another, no table is broadcast but those 65,536 rows.

A null or empty text is its end byte only. A null id is held out. Repeated
rows are scored each (and train each). An empty table gives an empty result; without training rows every decision has
probability one half. One text must fit into a task's memory, about 30 times its bytes.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import Index, parts_of, starts_of, stored, sums_between, tasks_for, texts_of

END = b"\n"
END_WORD = b"\n"  # no word contains it
BLOCK_BYTES = 24_000_000
PIECE_BYTES = 1_000_000  # worked on at a time; a gram takes about 60 bytes while it is
HALF = math.log(0.5)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after shifting the argument above 8."""
    shift = np.zeros_like(x)
    y = x.copy()
    for _ in range(8):
        low = y < 8
        shift[low] -= np.log(y[low])
        y[low] += 1
    z = 1 / (y * y)
    series = (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z * (1 / 1680 - z / 1188)))) / y
    return shift + (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + series


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a string with so many zeros and ones."""
    a, b = zeros.astype(float), ones.astype(float)
    return log_gamma(a + 0.5) + log_gamma(b + 0.5) - log_gamma(a + b + 1) - math.log(math.pi)


def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order with the sums of their counts."""
    key = np.concatenate([np.zeros(0, np.uint64), *keys])
    count = np.concatenate([np.zeros(0, np.int64), *counts])
    if not len(key):
        return key, count
    order = np.argsort(key)
    key, count = key[order], count[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[first], np.add.reduceat(count, first)


def grams_of(streams: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Packed context and symbol at every byte of every stream, and where each stream's begin (and the end)."""
    pad = END * depth
    raw = np.frombuffer(pad + pad.join(streams), np.uint8).astype(np.uint64)
    n = len(raw) - depth
    packed = raw[:n].copy()
    for k in range(1, depth + 1):
        packed <<= np.uint64(8)
        packed |= raw[k:k + n]
    lengths = np.fromiter(map(len, streams), np.int64, len(streams))
    runs = np.stack([lengths, np.full(len(streams), depth)], axis=1).ravel()[:-1]
    return packed[np.repeat(np.arange(len(runs)) % 2 == 0, runs)], starts_of(lengths)


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(parts)


def by_part(keys: np.ndarray, parts: int):
    """(part, places of its keys) of the parts that have keys; places stay in key order."""
    part = part_of(keys, parts)
    order = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[order], np.arange(parts + 1, dtype=np.uint64))
    return [(p, order[cuts[p]:cuts[p + 1]]) for p in range(parts) if cuts[p + 1] > cuts[p]]


def longs(blob, kind=np.uint64) -> np.ndarray:
    return np.frombuffer(blob or b"", kind)


class Block:
    """The distinct words and grams of texts gathered by a task."""

    def __init__(self, depth: int):
        self.depth, self.bytes = depth, 0
        self.index, self.counts = Index(), np.zeros(0, np.int64)
        self.keys, self.key_counts = [], []

    def add(self, streams: list[bytes], train: np.ndarray):
        words = [words_of(s) for s in streams]
        flat = self.index.numbers([w for own in words for w in own])
        trained = np.bincount(flat[np.repeat(train, list(map(len, words)))], minlength=len(self.index))
        trained[:len(self.counts)] += self.counts
        self.counts = trained
        gram, starts = grams_of(streams, self.depth)
        seen = np.repeat(train, np.diff(starts))
        distinct, times = np.unique(gram[seen], return_counts=True)
        other = np.unique(gram[~seen])
        self.keys += [distinct, other]
        self.key_counts += [times, np.zeros(len(other), np.int64)]
        if len(self.keys) > 12:
            key, count = merged(self.keys, self.key_counts)
            self.keys, self.key_counts = [key], [count]
        self.bytes += sum(map(len, streams))

    def distinct(self):
        """(keys in order, training counts) of words and of grams."""
        key, order = word_keys(self.index)
        return (key, self.counts[order]), merged(self.keys, self.key_counts)


def distinct_keys(keys: list[np.ndarray]) -> np.ndarray:
    """Distinct keys in order; one copy of them is sorted in place."""
    key = np.concatenate([np.zeros(0, np.uint64), *keys])
    keys.clear()
    key.sort()
    return key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key


def words_of(stream: bytes) -> list[bytes]:
    return [*stream[:-1].split(), END_WORD]


def packed(ids, train: np.ndarray, streams: list[bytes]) -> bytes:
    """Texts as one compressed Arrow stream."""
    import pyarrow as pa

    sink = pa.BufferOutputStream()
    rows = pa.record_batch([ids, pa.array(~train), pa.array(streams, pa.binary())], ["doc_id", "held_out", "stream"])
    options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=6))
    with pa.ipc.new_stream(sink, rows.schema, options=options) as out:
        out.write_batch(rows)
    return sink.getvalue().to_pybytes()


def gathered_rows(rows):
    """(block, part, kind, one, two) tuples as an Arrow batch: a text blob is kind 0, words are kind 1, grams kind 2."""
    import pyarrow as pa

    kinds = {"block": pa.int64(), "part": pa.int32(), "kind": pa.int32(), "one": pa.binary(), "two": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds.values())], list(kinds))


def word_keys(index: Index) -> tuple[np.ndarray, np.ndarray]:
    """Sorted 64-bit hashes of the words, and the words' numbers in that order."""
    from xxhash import xxh3_64_intdigest

    keys = np.fromiter(map(xxh3_64_intdigest, index), np.uint64, len(index))
    order = np.argsort(keys)
    return keys[order], order


class Trees:
    """The depths from ``depth`` down to two of all trees over the given grams."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray, depth: int):
        self.depth, self.levels = depth, {}
        grams, counts = grams[counts > 0], counts[counts > 0].astype(np.int64)
        key, bit = self.decisions(grams)
        key, times = key.ravel(), np.repeat(counts, 8)
        below = None
        ones = times * bit.ravel()
        zeros = times - ones
        for d in range(depth, 1, -1):
            # At each depth the oldest byte of the context goes.
            key = key & np.uint64((1 << 8 * (d + 1)) - 1)
            distinct, inverse = np.unique(key, return_inverse=True)
            total = lambda values: np.bincount(inverse, values, len(distinct)).astype(float)  # noqa: E731, B023
            zeros, ones = total(zeros), total(ones)
            own = log_kt(zeros, ones)
            both = own if below is None else np.logaddexp(HALF + own, HALF + total(below))
            weight = np.zeros(len(own)) if below is None else np.exp(HALF + own - both)
            self.levels[d] = (distinct, zeros, ones, weight)
            key, below = distinct, both
        self.top = (key, below)

    @staticmethod
    def decisions(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For every gram its eight (context, node) keys and bits; a node is the bits before it behind a leading one."""
        step = np.arange(8, dtype=np.uint64)
        symbol = (grams & np.uint64(255))[:, None]
        node = (np.uint64(1) << step) | (symbol >> (np.uint64(8) - step))
        bit = (symbol >> (np.uint64(7) - step)) & np.uint64(1)
        return (grams & ~np.uint64(255))[:, None] | node, bit.astype(np.int64)

    def sums(self):
        """(last context byte and node, zeros, ones, log of the product of Pw) of depth two, summed over the second byte."""
        key, below = self.top
        _, zeros, ones, _ = self.levels[2]
        distinct, inverse = np.unique(key & np.uint64(0xFFFF), return_inverse=True)
        return distinct, *[np.bincount(inverse, v, len(distinct)).astype(float) for v in (zeros, ones, below)]

    def log10(self, grams: np.ndarray, shallow) -> np.ndarray:
        """Log10 probability of every gram's symbol in its context; ``shallow`` has depths one and zero."""
        key, bit = self.decisions(grams)
        p, known = np.full(key.shape, 0.5), np.zeros(key.shape, bool)
        for d in range(self.depth, -1, -1):
            at = key & np.uint64((1 << 8 * (d + 1)) - 1)
            if d > 1:
                distinct, zeros, ones, weight = self.levels[d]
                if not len(distinct):
                    continue
                place = np.minimum(np.searchsorted(distinct, at), len(distinct) - 1)
                found = distinct[place] == at
            else:
                zeros, ones, weight = shallow[d]
                place = at.astype(np.int64)
                found = zeros[place] + ones[place] > 0
            a, b = zeros[place], ones[place]
            estimate = (np.where(bit == 1, b, a) + 0.5) / (a + b + 1)
            w = np.where(known, weight[place], 1.0)
            p = np.where(found, w * estimate + (1 - w) * p, p)
            known |= found
        return np.log10(p).sum(axis=1)


def shallow_depths(rows) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Zeros, ones and weights of depths one and zero from the sums (key, zeros, ones, below) of depth two."""
    out, below = {}, np.zeros(1 << 16)
    zeros, ones = np.zeros(1 << 16), np.zeros(1 << 16)
    for key, a, b, product in rows:
        zeros[key], ones[key], below[key] = a, b, product
    for d in (1, 0):
        own = log_kt(zeros, ones)
        both = np.logaddexp(HALF + own, HALF + below)
        out[d] = (zeros, ones, np.exp(HALF + own - both))
        zeros, ones, below = (v.reshape(-1, 256).sum(axis=0) for v in (zeros, ones, both))
    return out


def _gathered(docs: DataFrame, depth: int, parts: int, id_col: str, text_col: str) -> DataFrame:
    from pyspark import TaskContext

    train = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 10 != 0
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), train.alias("train"))

    def gather(batches):
        n, block = TaskContext.get().partitionId() << 24, Block(depth)

        def keys():
            for kind, (key, count) in enumerate(block.distinct(), 1):
                for p, at in by_part(key, parts):
                    yield gathered_rows([(n, p, kind, key[at].tobytes(), count[at].astype(np.uint32).tobytes())])

        for batch in batches:
            for piece in parts_of(batch, PIECE_BYTES):
                train = piece.column(2).to_numpy(zero_copy_only=False).astype(bool)
                streams = [b" ".join(d.lower().split()) + END for d in texts_of(piece.column(1))]
                yield gathered_rows([(n, 0, 0, packed(piece.column(0), train, streams), None)])
                block.add(streams, train)
                if block.bytes > BLOCK_BYTES:
                    yield from keys()
                    n, block = n + 1, Block(depth)
        if block.bytes:
            yield from keys()

    return rows.mapInArrow(gather, "block long, part int, kind int, one binary, two binary")


def _merge_part(depth: int, parts: int):
    """Of one part: its words' (distinct, total) training counts, and its distinct grams dealt out by their last two context bytes."""
    import pyarrow as pa

    def work(table):
        kind = table.column("kind").to_numpy()
        one, two = table.column("one").to_pylist(), table.column("two").to_pylist()
        pick = lambda k: ([longs(one[i]) for i in np.flatnonzero(kind == k)],
                          [longs(two[i], np.uint32).astype(np.int64) for i in np.flatnonzero(kind == k)])
        words, grams = merged(*pick(1)), merged(*pick(2))
        suffix = (grams[0] >> np.uint64(8)) & np.uint64(0xFFFF)
        out = [(p, grams[0][at].tobytes(), grams[1][at].tobytes(), 0, 0) for p, at in by_part(suffix, parts)]
        out.append((-1, None, None, int((words[1] > 0).sum()), int(words[1].sum())))
        return pa.table({"home": pa.array([r[0] for r in out], pa.int32()), "grams": pa.array([r[1] for r in out], pa.binary()),
                         "counts": pa.array([r[2] for r in out], pa.binary()),
                         "distinct_words": pa.array([r[3] for r in out], pa.int64()),
                         "total_words": pa.array([r[4] for r in out], pa.int64())})

    return work


def _home_grams(table):
    return merged([longs(g) for g in table.column("grams").to_pylist()],
                  [longs(c, np.int64) for c in table.column("counts").to_pylist()])


def score_texts(docs: DataFrame, depth: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte) of every row."""
    import pyarrow as pa

    parts = tasks_for(docs, docs.count(), 10_000)
    rows = stored(_gathered(docs, depth, parts, id_col, text_col))
    keys = rows.filter("kind > 0")
    model = stored(keys.groupBy("part").applyInArrow(
        _merge_part(depth, parts), "home int, grams binary, counts binary, distinct_words long, total_words long"))
    kinds, total = model.agg(F.coalesce(F.sum("distinct_words"), F.lit(0)), F.coalesce(F.sum("total_words"), F.lit(0))).first()
    homes = model.filter("home >= 0").select("home", "grams", "counts")

    def sums(table):
        key, *values = Trees(*_home_grams(table), depth).sums()
        return pa.table([pa.array(key.astype(np.int64)), *map(pa.array, values)], names=["key", "zeros", "ones", "below"])

    shallow = shallow_depths(
        homes.groupBy("home").applyInArrow(sums, "key long, zeros double, ones double, below double")
        .groupBy("key").agg(F.sum("zeros"), F.sum("ones"), F.sum("below")).collect())

    def values(table):
        grams, counts = _home_grams(table)
        log10 = Trees(grams, counts, depth).log10(grams, shallow)
        out = [(p, grams[at].tobytes(), log10[at].tobytes()) for p, at in by_part(grams, parts)]
        return pa.table([pa.array([r[0] for r in out], pa.int32()), pa.array([r[1] for r in out], pa.binary()),
                         pa.array([r[2] for r in out], pa.binary())], names=["part", "grams", "log10"])

    valued = homes.groupBy("home").applyInArrow(values, "part int, grams binary, log10 binary")

    def answer(asked, known):
        """To every block the values of its keys: counts of words, log10 probabilities of grams."""
        kind, block, two = (asked.column(c).to_pylist() for c in ("kind", "block", "two"))
        one = [o.as_buffer() for o in asked.column("one")]
        words, counts = merged([longs(o) for o, k in zip(one, kind) if k == 1],
                               [longs(t, np.uint32).astype(np.int64) for t, k in zip(two, kind) if k == 1])
        grams = np.concatenate([np.zeros(0, np.uint64), *(longs(g.as_buffer()) for g in known.column("grams"))])
        log10 = np.concatenate([np.zeros(0), *[longs(v.as_buffer(), float) for v in known.column("log10")]])
        order = np.argsort(grams)
        grams, log10 = grams[order], log10[order]
        out = []
        for b, k, o in zip(block, kind, one):
            own = longs(o)
            value = counts[np.searchsorted(words, own)] if k == 1 else log10[np.searchsorted(grams, own)]
            out.append((b, k, value.tobytes()))
        del words, counts, grams, log10, order
        return pa.table([pa.array([r[0] for r in out], pa.int64()), pa.array([asked.column("part")[0].as_py()] * len(out), pa.int32()),
                         pa.array([r[1] for r in out], pa.int32()), pa.array([r[2] for r in out], pa.binary())],
                        names=["block", "part", "kind", "value"])

    asked = keys.select("part", "block", "kind", "one", F.when(F.col("kind") == 1, F.col("two")).alias("two"))
    answered = asked.groupBy("part").cogroup(valued.groupBy("part")).applyInArrow(
        answer, "block long, part int, kind int, value binary")
    per_word = math.log10(total + 0.1 * (kinds + 1)) if total else 0.0

    def score(texts, answers):
        """Scores of a block. Its distinct keys are found again, in the order in which their values were asked for."""
        index, keys = Index(), []
        batches = lambda: (b for blob in texts.column("one") for b in pa.ipc.open_stream(blob.as_buffer()))
        for batch in batches():
            streams = batch.column(2).to_pylist()
            index.numbers([w for s in streams for w in words_of(s)])
            keys.append(distinct_keys([grams_of(streams, depth)[0]]))
            if len(keys) > 6:
                keys = [distinct_keys(keys)]
        gram, (word, order) = distinct_keys(keys), word_keys(index)
        # Values stay views of the Arrow column.
        values = {(k, p): v.as_buffer() for k, p, v in zip(answers.column("kind").to_pylist(), answers.column("part").to_pylist(), answers.column("value"))}
        count, log10 = np.zeros(len(word), np.int64), np.zeros(len(gram))
        for kind, key, value in ((1, word, count), (2, gram, log10)):
            for p, at in by_part(key, parts):
                value[at] = longs(values.pop((kind, p)), value.dtype)
        known = np.zeros(len(word), np.int64)
        known[order] = count
        done = []
        for batch in batches():
            streams = batch.column(2).to_pylist()
            words = [words_of(s) for s in streams]
            c, starts = known[index.numbers([w for own in words for w in own])], starts_of(map(len, words))
            base = np.log10(c + 0.1) - per_word if total else np.zeros(len(c))
            own, ends = grams_of(streams, depth)
            distinct, inverse = np.unique(own, return_inverse=True)
            total_log = sums_between(log10[np.searchsorted(gram, distinct)][inverse], ends)
            size = np.diff(ends)
            done.append(pa.table([
                batch.column(0), batch.column(1), pa.array(np.diff(starts)), pa.array(sums_between((c > 0).astype(np.int64), starts)),
                pa.array(np.full(len(streams), total)), pa.array(sums_between(base, starts)), pa.array(total_log),
                pa.array(size), pa.array(-total_log / math.log10(2) / size)],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes", "bits_per_byte"]))
        return pa.concat_tables(done)

    return rows.filter("kind = 0").select("block", "one").groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(
        score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, "
               "score double, n_bytes long, bits_per_byte double")
