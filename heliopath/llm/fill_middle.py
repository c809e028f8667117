"""Fill-in-middle: a text is cut into prefix, middle and suffix at two unit boundaries and written in another order.

Units are code points, words (each with the blanks behind it) or lines. A text
is held as fixed blocks of bytes; a Fenwick tree over the blocks has the
number of units and of code points that begin in each. A binary-lifting
descent finds the block in which a boundary lies, and the boundary is then
looked up in that block alone, with the code points before it.

The two cuts and the two draws of a row come from the first four 8-digit groups
of sha256("<seed>:<id>") in hexadecimal, so reruns agree and rows of one id are
cut at the same share of their draws. A null id draws as the empty string. A null or empty
text, a text that has one of the marks in it, and the rows not drawn stay
``plain``: their output is the text itself (empty for null) and prefix_chars
and middle_chars are null. Repeated rows give repeated results; an empty table
gives an empty result. Carried columns come back in the struct ``row``, so
their names may be any.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import parts_of, texts_of

BLOCK = 4096
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"  # marks, none begins inside another
MARKS = tuple(m.encode() for m in (PREFIX, SUFFIX, MIDDLE))
UNITS = ("code point", "word", "line")


def code_point_starts(data: np.ndarray) -> np.ndarray:
    return (data & 0xC0) != 0x80


def unit_starts(data: np.ndarray, unit: str) -> np.ndarray:
    """Marks the bytes at which a unit begins; the first unit begins at the first byte."""
    if unit == "code point":
        return code_point_starts(data)
    if unit == "line":
        behind = data == 10
        starts = np.concatenate([[False], behind[:-1]])
    else:
        blank = (data == 32) | ((data >= 9) & (data <= 13))
        starts = np.concatenate([[False], blank[:-1]]) & ~blank
    starts[:1] = True
    return starts


class BlockTree:
    """Fenwick tree over the blocks of a text: units and code points that begin in them."""

    def __init__(self, data: bytes, unit: str = "code point", block: int = BLOCK):
        self.data, self.unit, self.block = np.frombuffer(data, np.uint8), unit, block
        edges = np.arange(0, len(data), block)
        both = [unit_starts(self.data, unit), code_point_starts(self.data)]
        counts = np.stack([np.add.reduceat(b, edges, dtype=np.int64) if len(edges) else np.zeros(0, np.int64) for b in both])
        before = np.concatenate([np.zeros((2, 1), np.int64), np.cumsum(counts, axis=1)], axis=1)
        place = np.arange(len(edges) + 1)
        self.tree = before - before[:, place - (place & -place)]  # node i sums the blocks of its lowest bit
        self.units, self.chars = before[:, -1].tolist()

    def find(self, unit: int) -> tuple[int, int]:
        """The byte and the code points before unit number ``unit``; at the text's end if there are no more."""
        if unit >= self.units:
            return len(self.data), self.chars
        at, n = 0, self.tree.shape[1] - 1
        left, chars = unit, 0
        step = 1 << n.bit_length() - 1
        while step:
            if at + step <= n and self.tree[0, at + step] <= left:
                at += step
                left -= int(self.tree[0, at])
                chars += int(self.tree[1, at])
            step >>= 1
        held = self.data[at * self.block:(at + 1) * self.block]
        # The first byte of a block may begin a word or line by what is before it.
        before = self.data[max(0, at * self.block - 1):at * self.block]
        starts = unit_starts(np.concatenate([before, held]), self.unit)[len(before):]
        if not at:
            starts[0] = True
        byte = int(np.flatnonzero(starts)[left])
        return at * self.block + byte, chars + int(code_point_starts(held[:byte]).sum())


def draws(key: str, seed: int) -> list[int]:
    digest = sha256(f"{seed}:{key}".encode()).hexdigest()
    return [int(digest[at:at + 8], 16) for at in range(0, 32, 8)]


def rearranged(data: bytes, key: str, seed: int, unit: str, percent: int, percent_spm: int):
    """(units, form, prefix_chars, middle_chars, output) of a text."""
    tree = BlockTree(data, unit)
    one, two, drawn, order = draws(key, seed)
    if not data or drawn % 100 >= percent or any(m in data for m in MARKS):
        return tree.units, "plain", None, None, data
    cuts = sorted((one % (tree.units + 1), two % (tree.units + 1)))
    (first, before), (second, both) = map(tree.find, cuts)
    prefix, middle, suffix = data[:first], data[first:second], data[second:]
    p, s, m = MARKS
    if order % 100 < percent_spm:
        return tree.units, "spm", before, both - before, b"".join((s, suffix, p, prefix, m, middle))
    return tree.units, "psm", before, both - before, b"".join((p, prefix, s, suffix, m, middle))


def fill_in_middle(docs: DataFrame, carry: list[str], unit: str = "code point", seed: int = 1, percent: int = 90,
                   percent_spm: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row as ``row`` (the columns of ``carry``) with n_units, form, prefix_chars, middle_chars and output.

    ``percent`` of the rows are cut, ``percent_spm`` of these have the suffix first.
    """
    import pyarrow as pa

    if unit not in UNITS:
        raise ValueError(f"unit must be one of {UNITS}")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"),
                       F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("key"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    made = [("n_units", T.LongType()), ("form", T.StringType()), ("prefix_chars", T.LongType()),
            ("middle_chars", T.LongType()), ("output", T.StringType())]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]

    def work(batches):
        for batch in batches:
            for part in parts_of(batch, text=2):
                results = [rearranged(data, key, seed, unit, percent, percent_spm)
                           for key, data in zip(part.column(1).to_pylist(), texts_of(part.column(2)))]
                columns = [pa.array(list(c), pa.binary() if k == pa.string() and i == 4 else k).cast(k)
                           for i, (c, k) in enumerate(zip(zip(*results), kinds))]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], ["row", *[name for name, _ in made]])

    return rows.mapInArrow(work, T.StructType([rows.schema["row"], *[T.StructField(n, k) for n, k in made]]))


def restored(output: Column, form: Column) -> Column:
    """The text again, from output and form alone: the marks are found where they first occur, as no piece has one."""
    size = F.char_length(output)

    def between(opening: str, closing: str) -> Column:
        begin = F.instr(output, opening) + len(opening)
        return F.substr(output, begin, F.instr(output, closing) - begin)

    middle = F.substr(output, F.instr(output, MIDDLE) + len(MIDDLE), size)
    return (F.when(form == "psm", F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE)))
            .when(form == "spm", F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX)))
            .otherwise(output))
