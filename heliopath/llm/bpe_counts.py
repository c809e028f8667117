"""Token counts by rank-synchronous merging of pre-tokens held as ragged arrays.

All pre-tokens of a batch lie in one flat array of symbol numbers with their
owners. A round finds every owner's lowest-rank pair, merges all its
occurrences at once and drops owners without a pair; the symbols that are left
are the tokens. Merging a pair everywhere before looking again is right only
if no merge needs a symbol that a later merge makes; the loader checks it.

A null or empty text has no tokens. Repeated rows are counted each. A text of
any length is read whole; only distinct words are merged, within one bounded
store per task that is emptied when full.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import Index, parts_of, starts_of, sums_between, texts_of

NO_PAIR = np.int64(1 << 40)
STORE = 400_000  # distinct words a task keeps

# Fixed values of the vocabulary's rules: its pre-token expression, here for ASCII and Latin letters in lower case, and
# the printable character that stands for each byte.
LETTERS = "a-z\u00df-\u00f6\u00f8-\u024f"
PRE_TOKEN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|[^{LETTERS}0-9]+").findall
LATIN = re.compile(rf"[\x00-\x7f{LETTERS}]*").fullmatch
PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_OF = {chr(b): b for b in PRINTED} | {chr(256 + n): b for n, b in enumerate(sorted({*range(256)} - {*PRINTED}))}


class RaggedMerger:
    """The merges of a vocabulary file as sorted arrays."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        model, vocab = said["model"], said["model"]["vocab"]
        self.library = Tokenizer.from_file(path)
        self.suffix = model.get("end_of_word_suffix") or ""
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        made = {a + b: rank for rank, (a, b) in enumerate(pairs)}
        if len(made) != len(pairs) or any(made.get(s, -1) > rank for rank, pair in enumerate(pairs) for s in pair):
            raise ValueError("a merge needs a symbol that a later merge makes")
        self.size = len(vocab) + 1
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.makes = np.array([vocab[a + b] for a, b in pairs], np.int64)
        chars = sorted(BYTE_OF, key=BYTE_OF.get)
        self.inner = np.array([vocab[c] for c in chars], np.int64)
        self.final = np.array([vocab[c + self.suffix] for c in chars], np.int64)
        special = [t["content"] for t in said.get("added_tokens", [])]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None

    def pre_tokens(self, word: str) -> tuple[list[bytes], int]:
        """Bytes of the pre-tokens of a word by the library's own rules, and the special strings in it.

        Most words hold only ASCII and Latin letters; they need no library call.
        """
        low = word.lower()
        if LATIN(low) and not (self.special and self.special.search(word)):
            return [t.encode() for t in PRE_TOKEN(low)], 0
        pieces = self.special.split(word) if self.special else [word]
        out = []
        for piece in pieces:
            if piece:
                normal = self.library.normalizer
                text = normal.normalize_str(piece) if normal else piece
                out += [bytes(map(BYTE_OF.__getitem__, t)) for t, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]
        return out, len(pieces) - 1

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NO_PAIR)

    def counts(self, pre_tokens: list[bytes]) -> np.ndarray:
        """Symbols left of each pre-token after all merges."""
        lengths = np.fromiter(map(len, pre_tokens), np.int64, len(pre_tokens))
        done = lengths.copy()
        flat = np.frombuffer(b"".join(pre_tokens), np.uint8)
        symbol = self.inner[flat]
        last = np.cumsum(lengths) - 1
        symbol[last] = self.final[flat[last]]
        owner = np.repeat(np.arange(len(pre_tokens)), lengths)
        while len(symbol) > 1:
            rank = np.full(len(symbol), NO_PAIR)
            within = owner[:-1] == owner[1:]
            rank[:-1][within] = self.rank(symbol[:-1][within], symbol[1:][within])
            first = np.flatnonzero(np.concatenate([[True], ~within]))
            lowest = np.minimum.reduceat(rank, first)
            runs = np.diff(np.append(first, len(symbol)))
            lowest_here = np.repeat(lowest, runs)
            chosen = (rank == lowest_here) & (rank < NO_PAIR)
            # Of pairs that overlap (a a a), every second one from the left merges.
            before = np.concatenate([[False], chosen[:-1]])
            place = np.arange(len(symbol))
            run_start = np.maximum.accumulate(np.where(chosen & ~before, place, 0))
            chosen &= (place - run_start) % 2 == 0
            symbol[chosen] = self.makes[rank[chosen]]
            keep = np.concatenate([[True], ~chosen[:-1]]) & (lowest_here < NO_PAIR)
            done -= np.bincount(owner[chosen], minlength=len(done))
            symbol, owner = symbol[keep], owner[keep]
        return done


@lru_cache(maxsize=2)
def merger(path: str) -> RaggedMerger:
    return RaggedMerger(path)


class WordCounts:
    """Token counts of words, kept for the words seen lately."""

    def __init__(self, path: str):
        self.merger = merger(path)
        self.reset()

    def reset(self):
        self.index, self.known = Index(), np.zeros(0, np.int64)

    def of(self, datas: list[bytes]) -> np.ndarray:
        if len(self.index) > STORE:
            self.reset()
        numbers, lengths = [], []
        for data in datas:
            words = data.split()
            numbers.append(self.index.numbers(words))
            lengths.append(len(words))
        self._learn()
        flat = np.concatenate([np.zeros(0, np.int64), *numbers])
        return sums_between(self.known[flat], starts_of(lengths))

    def _learn(self):
        fresh = list(self.index)[len(self.known):]
        found, owners = [], []
        counts = np.zeros(len(fresh), np.int64)
        for i, word in enumerate(fresh):
            pre_tokens, special = self.merger.pre_tokens(word.decode())
            counts[i] = special
            for t in pre_tokens:
                found.append(t)
                owners.append(i)
        if found:
            np.add.at(counts, owners, self.merger.counts(found))
        self.known = np.concatenate([self.known, counts])


def token_counts(docs: DataFrame, path: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row; one pass, no shuffle."""
    import pyarrow as pa

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def count(batches):
        words = WordCounts(path)
        for batch in batches:
            for part in parts_of(batch):
                datas = texts_of(part.column(1))
                n = words.of(datas)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(d) for d in datas], pa.int64()), pa.array(n, pa.int64()),
                     pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
