"""Benchmark decontamination with spaced seeds.

Fixed masks read some word positions of a window and ignore the others, so a
window still hits when an ignored word was replaced. Windows of the benchmark
items are hashed under every mask into a sorted table; windows of every
document are hashed the same way and looked up. Around each hit the item is
laid over the document, word against word, and the stretch with the best score
(a match counts 1, a substitution -4, so at least four fifths of its words
agree) decides: an item leaks if the stretch has ``least_words`` words and
``share`` of the item at least. It also leaks if the whole item lies over the
document and four fifths of its words agree, however short it is and wherever the
others stand. An item that the document's border cuts has its best stretch only.

In short items the other words can stand so that no mask hits. Items of 5 to 19 words are also hashed
whole, without the words of each such way to have four fifths; documents are looked up
under these masks only if the block has items of that length.

The benchmark is worked off in blocks of ``block_words`` words, each small
enough to send to every task, so any size of benchmark is covered; documents
are not shuffled. Words are runs of letters, digits or non-ASCII characters,
lower-cased. Items of fewer than five words, null or empty ones match nothing,
null and empty documents neither. Equal items are each reported.
"""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import Index, let_go, parts_of, texts_of

MASKS = ("11111", "1111011", "11011011", "111011101")
STORE = 400_000
PLAIN_WORDS = re.compile(rb"[a-z0-9\x80-\xff]+").findall
FACTORS = np.random.RandomState(11).randint(1 << 62, size=64, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


class WordHashes:
    """64-bit hashes of the words of texts."""

    def __init__(self):
        self.index, self.known = Index(), np.zeros(0, np.uint64)

    def of(self, datas: list[bytes]) -> list[np.ndarray]:
        from xxhash import xxh3_64_intdigest

        if len(self.index) > STORE:
            self.__init__()
        numbers = [self.index.numbers(PLAIN_WORDS(d.lower())) for d in datas]
        fresh = list(self.index)[len(self.known):]
        self.known = np.concatenate([self.known, np.fromiter(map(xxh3_64_intdigest, fresh), np.uint64, len(fresh))])
        return [self.known[n] for n in numbers]


def _missed(n: int) -> list[str]:
    """Whole-length masks for the ways to have four fifths of n words that no mask of MASKS hits."""
    ways = (set(holes) for holes in combinations(range(n), n // 5))
    hit = lambda holes: any(all(m == "0" or at + k not in holes for k, m in enumerate(mask))
                            for mask in MASKS for at in range(n - len(mask) + 1))
    return ["".join("0" if k in holes else "1" for k in range(n)) for holes in ways if not hit(holes)]


EXTRA = [mask for n in range(5, 20) for mask in _missed(n)]
SHAPES = (*MASKS, *EXTRA)
#: Mask number -> the item length it is for.
SHORT = {len(MASKS) + at: len(mask) for at, mask in enumerate(EXTRA)}


def seed_hashes(words: np.ndarray, mask: int) -> np.ndarray:
    """Hash of every window under a mask; empty if the text is shorter than the mask."""
    shape = SHAPES[mask]
    n = len(words) - len(shape) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, FACTORS[-1 - mask])
    for at, read in enumerate(shape):
        if read == "1":
            total = total + words[at:at + n] * FACTORS[at]
    return total


class SeedTable:
    """Sorted seed hashes of some items, with a bit table that rules out most others."""

    def __init__(self, items: list[tuple[object, bytes]]):
        self.ids = [i for i, _ in items]
        self.words = WordHashes().of([t for _, t in items])
        hashes, owner, place = [], [], []
        lengths = {len(w) for w in self.words}
        self.masks = [m for m in range(len(SHAPES)) if m not in SHORT or SHORT[m] in lengths]
        for k, words in enumerate(self.words):
            for mask in self.masks:
                if SHORT.get(mask, len(words)) != len(words):
                    continue
                h = seed_hashes(words, mask)
                hashes.append(h)
                owner.append(np.full(len(h), k))
                place.append(np.arange(len(h)))
        flat = np.concatenate([np.zeros(0, np.uint64), *hashes])
        order = np.argsort(flat, kind="stable")
        self.hashes = flat[order]
        self.owner = np.concatenate([np.zeros(0, np.int64), *owner])[order]
        self.place = np.concatenate([np.zeros(0, np.int64), *place])[order]
        self.bits = np.zeros(1 << 20, bool)
        self.bits[self.hashes >> np.uint64(44)] = True

    def diagonals(self, words: np.ndarray) -> set[tuple[int, int]]:
        """(item, offset of the item's first word in the document) of all hits."""
        found = set()
        for mask in self.masks:
            h = seed_hashes(words, mask)
            maybe = np.flatnonzero(self.bits[h >> np.uint64(44)])
            if len(maybe):
                left, right = np.searchsorted(self.hashes, h[maybe], "left"), np.searchsorted(self.hashes, h[maybe], "right")
                runs = right - left
                at = np.repeat(left - np.concatenate([[0], np.cumsum(runs)[:-1]]), runs) + np.arange(runs.sum())
                found.update(zip(self.owner[at].tolist(), (np.repeat(maybe, runs) - self.place[at]).tolist()))
        return found

    def leaks(self, words: np.ndarray, least_words: int, share: float) -> dict[int, tuple[int, int, int, int]]:
        """item -> (first word in the document, first word in the item, words laid over, words equal), the best of each."""
        best = {}
        for item, shift in self.diagonals(words):
            own = self.words[item]
            low, high = max(0, -shift), min(len(own), len(words) - shift)
            same = own[low:high] == words[low + shift:high + shift]
            score = np.concatenate([[0], np.cumsum(np.where(same, 1, -4))])
            gain = score - np.minimum.accumulate(score)
            end = int(np.argmax(gain))
            begin = int(np.argmin(score[:end + 1]))
            equal = int(same[begin:end].sum())
            found = (low + shift + begin, low + begin, end - begin, equal)
            passes = end - begin >= max(least_words, share * len(own))
            if not passes:
                equal = int(same.sum())
                found = (low + shift, low, high - low, equal)
                passes = high - low == len(own) and 5 * equal >= 4 * len(own)
            if passes and (item not in best or (equal, -found[0]) > (best[item][3], -best[item][0])):
                best[item] = found
        return best


def seed_tables(benchmark: DataFrame, id_col: str, text_col: str, block_words: int):
    """The items' tables, one block after another."""
    items = benchmark.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text is not null")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-total // (6 * block_words)))
    for k in range(blocks):
        mine = items.filter(F.pmod(F.xxhash64("text", "id"), F.lit(blocks)) == k).collect()
        if mine:
            yield SeedTable([(r.id, r.text.encode()) for r in sorted(mine, key=lambda r: (r.id is None, r.id, r.text))])


def leaks(docs: DataFrame, benchmark: DataFrame, least_words: int = 8, share: float = 0.5, block_words: int = 500_000,
          id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """(doc_id, item_id, doc_start, item_start, overlap, equal): the best overlay of each leaking item in each row."""
    import pyarrow as pa

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    spark, names = docs.sparkSession, ["doc_id", "item_id", "doc_start", "item_start", "overlap", "equal"]
    schema = ", ".join(f"{n} long" for n in names)

    def search(shared):
        def work(batches):
            table, hashes = shared.value, WordHashes()
            for batch in batches:
                for part in parts_of(batch):
                    out = [(doc_id, table.ids[item], *found)
                           for doc_id, words in zip(part.column(0).to_pylist(), hashes.of(texts_of(part.column(1))))
                           for item, found in table.leaks(words, least_words, share).items()]
                    yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], pa.int64()) for c in range(6)], names)
        return work

    found = spark.createDataFrame([], schema)
    for table in seed_tables(benchmark, item_col, text_col, block_words):
        found = found.union(rows.mapInArrow(search(spark.sparkContext.broadcast(table)), schema))
    return found


def without_leaks(docs: DataFrame, benchmark: DataFrame, least_words: int = 8, share: float = 0.5,
                  block_words: int = 500_000, text_col: str = "text", item_text_col: str = "text",
                  item_col: str = "item_id") -> DataFrame:
    """The rows in which no item leaks, all columns unchanged."""
    spark, at = docs.sparkSession, docs.columns.index(text_col)

    def clear(shared):
        def work(batches):
            import pyarrow as pa

            table, hashes = shared.value, WordHashes()
            for batch in batches:
                for part in parts_of(batch, text=at):
                    words = hashes.of(texts_of(part.column(at)))
                    yield part.filter(pa.array([not table.leaks(w, least_words, share) for w in words], pa.bool_()))
            # What follows in a pipeline may run in the JVM alone, beside this worker.
            del table, hashes
            let_go()
        return work

    for table in seed_tables(benchmark, item_col, item_text_col, block_words):
        docs = docs.mapInArrow(clear(spark.sparkContext.broadcast(table)), docs.schema)
    return docs
