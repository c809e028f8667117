"""Quality by importance resampling: hashed n-gram models of target and raw text.

Words and word pairs of a text are hashed to a fixed number of buckets. Two
bag models over the buckets, one of the raw corpus (all rows) and one of the
target (labelled clean rows), give every text the log of its importance
weight: the sum over its features of log p_target - log p_raw.

That sum says how a text reads as a whole; a few words that clean texts never
have drown in it. So a second model has buckets of its own for words alone and counts the texts
that have them: ``word_weight`` sums, over the distinct words of a text, the
log of clean texts with the word over those expected from all rows, where the
two differ by more than ``SURE`` standard deviations, and nothing elsewhere.

Either weight is taken from the level under which half of ``loss`` of unseen clean rows lie; the worse one counts. Adding Gumbel
noise, made from the id, and taking the k largest draws k rows without
replacement by weight.

The raw counts cover all rows. The target model is fitted on at most ``most_labelled`` labelled ids, those with the
least hashes, so that the id list sent to the tasks stays small. ``k`` is set from labels the model
has not seen: so many rows that the share ``loss`` of clean labelled rows falls out.

A null or empty text has no feature and weight 0. Rows whose keys tie with the
k-th (in millionths; repeated rows always tie) are all taken. Without clean labels every weight is 0 and
all rows are taken. Labels of unknown ids count for nothing; an id with several labels is
clean only if all are.
"""

from __future__ import annotations

import re
from zlib import crc32

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import Index, parts_of, starts_of, stored, sums_between, texts_of

BUCKETS = 10_000
WORD_BUCKETS, SURE = 1 << 20, 2.5
STORE, PART_BYTES = 200_000, 2_000_000
FEATURE_WORDS = re.compile(rb"[a-z0-9_\x80-\xff]+|[^a-z0-9_\x80-\xff\s]+").findall


class Features:
    """Bucket numbers of the words and word pairs of texts."""

    def __init__(self):
        self.index, self.hashes = Index(), np.zeros(0, np.uint64)

    def _hashed(self, datas: list[bytes]) -> list[np.ndarray]:
        if len(self.index) > STORE:
            self.__init__()
        numbers = [self.index.numbers(FEATURE_WORDS(d.lower())) for d in datas]
        fresh = list(self.index)[len(self.hashes):]
        self.hashes = np.concatenate([self.hashes, np.fromiter(map(crc32, fresh), np.uint64, len(fresh))])
        return [self.hashes[n] for n in numbers]

    def of(self, datas: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of all texts in a row, and where each text's begin (and the end)."""
        return self._joined(self._hashed(datas))

    def with_words(self, datas: list[bytes]):
        """What ``of`` gives, and the same of the word buckets, each once a text."""
        hashed = self._hashed(datas)
        words = [np.unique((h * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(20)) % np.uint64(WORD_BUCKETS)).astype(np.int64)
                 for h in hashed]
        return *self._joined(hashed), np.concatenate([np.zeros(0, np.int64), *words]), starts_of(map(len, words))

    @staticmethod
    def _joined(hashed: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        out, lengths = [np.zeros(0, np.int64)], []
        for h in hashed:
            pairs = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
            both = np.concatenate([h * np.uint64(0xD6E8FEB86659FD93), pairs]) >> np.uint64(20)
            out.append((both % np.uint64(BUCKETS)).astype(np.int64))
            lengths.append(len(both))
        return np.concatenate(out), starts_of(lengths)


def _clean_ids(labels: DataFrame, id_col: str, clean: Column) -> DataFrame:
    """(doc_id, clean, fitting): labelled ids, halved by hash."""
    ids = labels.groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(
        F.min(F.coalesce(clean, F.lit(False)).cast("int")).alias("clean"))
    return ids.filter("doc_id is not null").withColumn("fitting", F.crc32(F.col("doc_id").cast("string")) % 2 == 0)


def log_ratios(docs: DataFrame, target_ids: DataFrame, id_col: str, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """log p_target - log p_raw per bucket, and the sure log ratios per word bucket; ``target_ids`` (doc_id) must be small."""
    import pyarrow as pa

    rows = (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
            .join(F.broadcast(target_ids.select("doc_id", F.lit(True).alias("wanted"))), "doc_id", "left")
            .select("doc_id", "text", F.coalesce("wanted", F.lit(False)).alias("wanted")))

    def count(batches):
        features = Features()
        # Kind 0 counts features, kind 1 the texts with a word, kind 2 texts.
        counts = [np.zeros((2, n), np.int64) for n in (BUCKETS, WORD_BUCKETS, 1)]
        for batch in batches:
            for part in parts_of(batch, PART_BYTES):
                bucket, starts, word, word_starts = features.with_words(texts_of(part.column(1)))
                chosen = part.column(2).to_numpy(zero_copy_only=False).astype(bool)
                texts = np.zeros(part.num_rows, np.int64)
                for c, found, lengths in zip(counts, (bucket, word, texts), (np.diff(starts), np.diff(word_starts), 1)):
                    c[0] += np.bincount(found, minlength=c.shape[1])
                    c[1] += np.bincount(found[np.repeat(chosen, lengths)], minlength=c.shape[1])
        for kind, c in enumerate(counts):
            at = np.flatnonzero(c[0])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), kind, np.int32)), pa.array(at), pa.array(c[0][at]), pa.array(c[1][at])],
                ["kind", "bucket", "raw", "target"])

    sums = stored(rows.mapInArrow(count, "kind int, bucket long, raw long, target long").groupBy("kind", "bucket")
                  .agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")))
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for _, bucket, r, t in sums.filter("kind = 0").collect():  # one row per bucket
        raw[bucket], target[bucket] = r, t
    words = np.zeros(WORD_BUCKETS)
    if not target.any():
        return np.zeros(BUCKETS), words
    _, _, texts, clean = sums.filter("kind = 2").first()
    expected = F.col("raw") * (clean / texts)
    sure = sums.filter("kind = 1").withColumn("expected", expected).filter(
        (F.col("expected") >= 1) & (F.abs(F.col("target") - F.col("expected")) > SURE * F.sqrt("expected")))
    for bucket, r in sure.select("bucket", F.log((F.col("target") + 0.5) / (F.col("expected") + 0.5))).collect():
        words[bucket] = r
    share = lambda c: np.log((c + 0.5) / (c.sum() + 0.5 * BUCKETS))
    return share(target) - share(raw), words


def weigh(docs: DataFrame, ratio: np.ndarray, words: np.ndarray, carry: list[str], text_col: str) -> DataFrame:
    """The carried columns in the struct ``row`` with n_features, log_weight and word_weight."""
    import pyarrow as pa
    import pyarrow.compute as pc

    at = carry.index(text_col) if text_col in carry else None

    def score(shared):
        def work(batches):
            features, (ratio, words) = Features(), shared.value
            for batch in batches:
                row = batch.column(0)
                text = batch.column(1) if at is None else pc.struct_field(row, [at])
                for part in parts_of(pa.RecordBatch.from_arrays([row, text], ["row", "text"]), PART_BYTES):
                    bucket, starts, word, word_starts = features.with_words(texts_of(part.column(1)))
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0), pa.array(np.diff(starts)), pa.array(sums_between(ratio[bucket], starts)),
                         pa.array(sums_between(words[word], word_starts))],
                        ["row", "n_features", "log_weight", "word_weight"])
        return work

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"),
                       *([F.col(f"`{text_col}`").alias("text")] if at is None else []))
    made = [T.StructField("n_features", T.LongType()), T.StructField("log_weight", T.DoubleType()),
            T.StructField("word_weight", T.DoubleType())]
    shared = docs.sparkSession.sparkContext.broadcast((ratio, words))
    return rows.mapInArrow(score(shared), T.StructType([rows.schema["row"], *made]))


def gumbel(id_column: Column, seed: int) -> Column:
    """Standard Gumbel noise that depends on id and seed only."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.coalesce(id_column.cast("string"), F.lit(""))), 12)
    return -F.log(-F.log((bits + 0.5) / float(1 << 52)))


def kth_largest(keys: DataFrame, k: int, bins: int = 4096) -> int:
    """The k-th largest of the longs in column ``q``; histograms of ever narrower ranges."""
    low, high = keys.agg(F.min("q"), F.max("q")).first()
    while low < high:
        width = max(1, -(-(high - low + 1) // bins))
        counts = (keys.filter(F.col("q").between(low, high))
                  .groupBy(F.floor((F.col("q") - low) / width).cast("long").alias("bin")).count().collect())
        for at, n in sorted(counts, reverse=True):
            if n >= k:
                low, high = low + at * width, min(high, low + (at + 1) * width - 1)
                break
            k -= n
        if width == 1:
            return low
    return low


def resample(docs: DataFrame, labels: DataFrame, carry: list[str], loss: float = 0.003, most_labelled: int = 200_000,
             seed: int = 7, id_col: str = "doc_id", text_col: str = "text", clean: Column | None = None) -> DataFrame:
    """Every row's carried columns as ``row`` with n_features, log_weight, word_weight, draw_key and selected (among the k largest).

    The carried columns must hold the id. Only ids and weights are kept between the steps: where whole rows are
    carried, they are weighed once more on the way out. ``clean`` is an expression over ``labels``.
    """
    clean = (F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0) if clean is None else clean
    labelled = stored(_clean_ids(labels, id_col, clean))
    fit = (labelled.filter("clean = 1 and fitting").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labelled))
    ratios = log_ratios(docs, fit, id_col, text_col)
    weighed = stored(weigh(docs, *ratios, [id_col], text_col))
    own_id = F.col(f"row.`{id_col}`")
    seen = stored(weighed.select(own_id.cast("long").alias("doc_id"), "log_weight", "word_weight").join(
        labelled.filter("clean = 1 and not fitting").select("doc_id"), "doc_id"))
    low, low_word = seen.agg(*[F.percentile_approx(w, loss / 2, 100_000) for w in ("log_weight", "word_weight")]).first()
    worse = F.least(F.col("log_weight") - F.lit(low or 0.0), F.col("word_weight") - F.lit(low_word or 0.0))
    draw_key = lambda weight, key: F.round(weight + gumbel(key, seed), 6)
    millionths = lambda key: F.round(key * 1_000_000).cast("long")
    keyed = weighed.withColumn("draw_key", draw_key(worse, own_id))
    out = keyed if carry == [id_col] else weigh(docs, *ratios, carry, text_col).withColumn("draw_key", draw_key(worse, own_id))
    least = seen.agg(F.percentile_approx(millionths(draw_key(worse, F.col("doc_id"))), loss, 100_000)).first()[0]
    if least is None:
        return out.withColumn("selected", F.lit(True))
    keys = keyed.select(millionths(F.col("draw_key")).alias("q"))
    k = keys.filter(F.col("q") >= least).count()
    cut = kth_largest(keys, k)
    return out.withColumn("selected", millionths(F.col("draw_key")) >= cut)
