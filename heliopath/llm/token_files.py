"""Token ids as Arrow files of equal-length sequences and masks.

``write_sequences`` cuts the documents into id ranges (a range-partitioned
shuffle of the texts), encodes each range in order and writes two Arrow files
for it in the random-access file format:

* ``part-N.seq.arrow``: record batches with the columns ``ids`` and ``ends``,
  both fixed-size lists of ``length`` values, uncompressed, so that a reader
  that maps the file gets row i of a batch without copying. ``ends`` is the
  mask of the last id of each document. The last sequence of a part is padded;
  its padding is whatever lies behind the last ``true`` of ``ends``.
* ``part-N.doc.arrow``: ``doc_id`` of the documents in the order they lie in.

Files get their final name by a rename when complete, and a part's content
depends on its rows only, so a lost task is simply run again. Ids take two
bytes where the vocabulary allows.

A null or empty text has only its end id. Null ids come first; rows with the
same id lie in the order of their texts. An empty table gives no parts.
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import Index, let_go, parts_of, per_worker, starts_of, texts_of

STORE = 900_000  # distinct chunks a worker keeps; beyond it, those seen once or rarely make room
SMALL_STORE = 300_000  # the same where earlier stages have left less memory
ROWS = 128  # sequences of a record batch

# A pre-token of the byte-level rule never holds white space behind other characters, so a text may be cut before each
# run of ASCII white space. Texts with any other white space are encoded in one call.
CHUNKS = re.compile(rb"\s*\S+|\s+").findall
ODD_BLANK = re.compile(rb" (?:[ \t-\r\x1c-\x1f\xc2\xe1\xe2\xe3]|\Z)").search
OTHER_SPACE = [*[bytes([c]) for c in range(0x1c, 0x20)], *[c.encode() for c in "\x85\xa0\u1680"], b"\xe2\x80", b"\xe2\x81", b"\xe3\x80\x80"]


def odd_space(data: bytes) -> bool:
    """Whether there may be white space beyond ASCII's."""
    return any(mark in data for mark in OTHER_SPACE)


# Most chunks are one pre-token of Latin letters and perhaps one of ASCII marks.
LETTERS = rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|[\xc4-\xc8][\x80-\xbf])+"
SIMPLE = re.compile(rb"( ?" + LETTERS + rb")([!-&(-/:-@\[-`{-~]*)").fullmatch

# Fixed values of the byte-level rule: the printable character that stands for each byte.
PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
CHARACTER = {b: chr(b) for b in PRINTED} | {b: chr(256 + n) for n, b in enumerate(sorted({*range(256)} - {*PRINTED}))}


@lru_cache(maxsize=2)
def library(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@per_worker
def encoder_of(path: str, end_id: int, store: int | None = None):
    """One encoder per worker process; what it has learned serves all its tasks."""
    return ChunkEncoder(path, end_id, store)


class ChunkEncoder:
    """Ids of texts; distinct chunks are encoded once by the library and kept for a while."""

    def __init__(self, path: str, end_id: int, store: int | None = None):
        self.tokenizer, self.end_id, self.store = library(path), end_id, store or STORE
        self.model = self.tokenizer.model
        self.dtype = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.index, self.ids, self.at, self.seen = Index(), np.zeros(0, self.dtype), np.zeros(1, np.int64), np.zeros(0, np.int64)

    def _make_room(self):
        """Keeps the chunks seen most often, half the store at most."""
        least = max(2, int(np.partition(self.seen, -self.store // 2)[-self.store // 2]) + 1)
        keep = np.flatnonzero(self.seen >= least)
        names, sizes = list(self.index), np.diff(self.at)[keep]
        starts = starts_of(sizes)
        self.ids = self.ids[np.repeat(self.at[keep] - starts[:-1], sizes) + np.arange(starts[-1])]
        self.index, self.at, self.seen = Index((names[k], n) for n, k in enumerate(keep)), starts, self.seen[keep] // 2

    def _learn(self):
        """Encodes the chunks not yet known. Words that are already known without their marks are copied."""
        known = len(self.at) - 1
        fresh = list(self.index)[known:]
        if not fresh:
            return
        found, rest, marks = [], [], {}
        get, at, ids, tokenize = self.index.get, self.at.tolist(), self.ids, self.model.tokenize
        spelled = lambda piece: [t.id for t in tokenize(piece.decode("latin-1").translate(CHARACTER))]
        for chunk in fresh:
            match = SIMPLE(chunk)
            if not match:
                rest.append(len(found))
                found.append(())
                continue
            word, tail = match.groups()
            n = get(word, known) if tail else known
            own = ids[at[n]:at[n + 1]].tolist() if n < known else spelled(word)
            if tail:
                if tail not in marks:
                    marks[tail] = spelled(tail)
                own += marks[tail]
            found.append(own)
        texts = [fresh[i].decode() for i in rest]
        for i, e in zip(rest, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
            found[i] = e.ids
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(found), self.dtype, int(sizes.sum()))])
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(sizes)])

    def _chunks(self, column) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the chunks of all texts in a row, and how many each text has.

        Where every blank stands before a character that is no white space, the
        text is cut at blanks; Arrow finds the distinct pieces of the batch, and
        only those are looked up.
        """
        import pyarrow as pa
        import pyarrow.compute as pc

        datas = texts_of(column)
        plain = np.fromiter((not (ODD_BLANK(d) or odd_space(d)) for d in datas), bool, len(datas))
        pieces = pc.split_pattern(pa.array([d if p else None for d, p in zip(datas, plain)], pa.binary()), b" ")
        coded = pieces.flatten().dictionary_encode()
        later = self.index.numbers([b" " + p for p in coded.dictionary.to_pylist()])
        flat = later[coded.indices.to_numpy()] if len(coded) else np.zeros(0, np.int64)
        counts = np.where(plain, pc.fill_null(pc.list_value_length(pieces), 0).to_numpy(), 0)
        ends = np.cumsum(counts)
        flat[(ends - counts)[plain]] = self.index.numbers([d.partition(b" ")[0] for d, p in zip(datas, plain) if p])
        out = np.split(flat, ends[:-1])
        for i in np.flatnonzero(~plain):
            out[i] = self.index.numbers([datas[i]] if odd_space(datas[i]) else CHUNKS(datas[i]))
        return np.concatenate(out), np.fromiter(map(len, out), np.int64, len(out))

    def of(self, column) -> tuple[np.ndarray, np.ndarray]:
        """All ids of an Arrow column of texts in a row, each text's followed by the end id, and the number of each text."""
        if len(self.index) > self.store:
            self._make_room()
        if not len(column):
            return np.zeros(0, self.dtype), np.zeros(0, np.int64)
        chunk, counts = self._chunks(column)
        self._learn()
        times = np.bincount(chunk, minlength=len(self.at) - 1)
        times[:len(self.seen)] += self.seen
        self.seen = times
        sizes = self.at[chunk + 1] - self.at[chunk]
        starts = starts_of(sizes)
        flat = self.ids[np.repeat(self.at[chunk] - starts[:-1], sizes) + np.arange(starts[-1])]
        doc_ends = starts[starts_of(counts)[1:]]
        return np.insert(flat, doc_ends, self.end_id), np.diff(doc_ends, prepend=0) + 1


def _files(root: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)


class PartWriter:
    """Writes the sequences of one part; holds less than one record batch."""

    def __init__(self, root: str, part: int, attempt: str, length: int, dtype):
        import pyarrow as pa

        self.fs, folder = _files(root)
        self.fs.create_dir(folder, recursive=True)
        kind = pa.uint16() if dtype == np.uint16 else pa.uint32()
        schemas = {"seq": pa.schema([("ids", pa.list_(kind, length)), ("ends", pa.list_(pa.bool_(), length))]),
                   "doc": pa.schema([("doc_id", pa.int64())])}
        self.names = {k: (f"{folder}/_{attempt}-{part:05d}.{k}", f"{folder}/part-{part:05d}.{k}.arrow") for k in schemas}
        self.sinks = {k: self.fs.open_output_stream(self.names[k][0]) for k in schemas}
        self.files = {k: pa.ipc.new_file(self.sinks[k], schemas[k]) for k in schemas}
        self.schemas, self.length, self.kind = schemas, length, kind
        self.ids, self.ends, self.total = np.zeros(0, dtype), np.zeros(0, bool), 0

    def add(self, doc_ids, ids: np.ndarray, counts: np.ndarray):
        import pyarrow as pa

        ends = np.zeros(len(ids), bool)
        ends[np.cumsum(counts) - 1] = True
        self.ids, self.ends = np.concatenate([self.ids, ids]), np.concatenate([self.ends, ends])
        self.total += len(ids)
        self.files["doc"].write_batch(pa.record_batch([doc_ids], schema=self.schemas["doc"]))
        block = self.length * ROWS
        whole = len(self.ids) // block * block
        for at in range(0, whole, block):
            self._batch(self.ids[at:at + block], self.ends[at:at + block])
        self.ids, self.ends = self.ids[whole:], self.ends[whole:]

    def _batch(self, ids, ends):
        import pyarrow as pa

        columns = [pa.FixedSizeListArray.from_arrays(pa.array(ids, self.kind), self.length),
                   pa.FixedSizeListArray.from_arrays(pa.array(ends), self.length)]
        self.files["seq"].write_batch(pa.record_batch(columns, schema=self.schemas["seq"]))

    def close(self):
        pad = -len(self.ids) % self.length
        if len(self.ids):
            self._batch(np.pad(self.ids, (0, pad)), np.pad(self.ends, (0, pad)))
        for k, file in self.files.items():
            file.close()
            self.sinks[k].close()
            self.fs.move(*self.names[k])


def write_sequences(docs: DataFrame, root: str, path: str, end_id: int, length: int = 2048,
                    id_col: str = "doc_id", text_col: str = "text", part_rows: int = 10_000,
                    store: int | None = None) -> DataFrame:
    """Writes all parts under ``root``; one row per part: (part, total ids, number of documents)."""
    import pyarrow as pa
    from pyspark import TaskContext

    from .tables import tasks_for

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    parts = tasks_for(docs, docs.count(), part_rows)
    ordered = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")

    def write(batches):
        let_go(encoder_of)
        context = TaskContext.get()
        encoder, writer, n = encoder_of(path, end_id, store), None, 0
        for batch in batches:
            for piece in parts_of(batch, 4_000_000):
                if writer is None:
                    writer = PartWriter(root, context.partitionId(), f"{context.taskAttemptId()}", length, encoder.dtype)
                ids, counts = encoder.of(piece.column(1))
                writer.add(piece.column(0), ids, counts)
                n += piece.num_rows
        if writer:
            writer.close()
            yield pa.RecordBatch.from_arrays(
                [pa.array([context.partitionId()], pa.int32()), pa.array([writer.total]), pa.array([n])],
                ["part", "total", "documents"])

    spark = docs.sparkSession
    made = ordered.mapInArrow(write, "part int, total long, documents long")
    # One short row per part; the write happens here, once.
    return spark.createDataFrame(made.collect(), made.schema)


def open_part(root: str, part: int):
    """(sequence file, documents file) readers; local files are mapped, so rows are views of the file."""
    import pyarrow as pa

    system, folder = _files(root)
    local = system.type_name == "local"

    def opened(kind):
        name = f"{folder}/part-{part:05d}.{kind}.arrow"
        return pa.ipc.open_file(pa.memory_map(name) if local else system.open_input_file(name))

    return opened("seq"), opened("doc")


def sequence(reader, i: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and end mask of sequence i of a part."""
    batch = reader.get_batch(i // ROWS)
    row = i % ROWS
    return (batch.column(0)[row].values.to_numpy(), batch.column(1)[row].values.to_numpy(zero_copy_only=False))


def documents_in(root: str, part: int):
    """(doc_id, ids) of the documents of a part, in order, read one record batch at a time."""
    seq, doc = open_part(root, part)
    names = (i for k in range(doc.num_record_batches) for i in doc.get_batch(k).column(0).to_pylist())
    held = np.zeros(0, np.uint16)
    for k in range(seq.num_record_batches):
        batch = seq.get_batch(k)
        ids = batch.column(0).flatten().to_numpy()
        ends = np.flatnonzero(batch.column(1).flatten().to_numpy(zero_copy_only=False)) + 1
        at = 0
        for end in ends:
            own = ids[at:end] if not len(held) else np.concatenate([held, ids[at:end]])
            held, at = held[:0], end
            yield next(names), own
        held = np.concatenate([held.astype(ids.dtype), ids[at:]])


def read_digests(spark: SparkSession, parts: DataFrame, root: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) read back from the files, one task per part or few."""
    import zlib

    import pyarrow as pa

    totals = sorted((r.part, r.total) for r in parts.collect())
    starts = starts_of(t for _, t in totals)
    todo = spark.createDataFrame([(p, int(s)) for (p, _), s in zip(totals, starts)], "part int, start long")

    def digest(batches):
        for batch in batches:
            for part, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = []
                for doc_id, ids in documents_in(root, part):
                    rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[c] for r in rows], pa.int64()) for c in range(4)],
                    ["doc_id", "start", "n_tokens", "ids_crc32"])

    return (todo.repartition(max(1, len(totals)), "part")
            .mapInArrow(digest, "doc_id long, start long, n_tokens long, ids_crc32 long"))
