import zlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from heliopath.llm.bpe_counts import token_counts
from heliopath.llm.token_files import documents_in, open_part, read_digests, sequence, write_sequences

from .helpers import awkward, documents

ODD = [None, "", "  ", "Hello, world. It's WE'LL don't 'sx", "a  b\n\n  c \t d\r\n", "aaaaaaa" * 40, "x" * 20_000, "ab " * 3_000,
       "<|endoftext|>x<|startoftext|> y<|endoftext|>", "É́ café ΣΑΣ  x 日本語 ١٢ \x1c a\x85b ﬁ İ × a×b c÷", "\x00 a\x00b é ́x ñ. ñ!?",
       "_x_ a_b. a1b2 3,4", "a \n\nThe b", "# ## #", "ĳ ŉ ǅ ſ K Å", "Hello, world. It's WE'LL don't 'sx"]
SAMPLE = "/root/testdata/sf0.001"


def rows(spark):
    made = [(i, t) for i, t in enumerate(ODD)] + [(3, ODD[3]), (None, "null id"), (3, "another text")]
    kept = spark.read.parquet(f"{SAMPLE}/documents.parquet").collect()
    return made + [(1000 + r.doc_id, r.text) for r in kept]


def test_counts_agree_with_the_library(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    library, all_rows = Tokenizer.from_file(path), rows(spark)
    got = token_counts(awkward(documents(spark, all_rows)), path, limit=100).collect()
    want = []
    for i, t in all_rows:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want.append((i, len((t or "").encode()), n, n > 100))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("part_rows", [10_000, 40])
def test_files_hold_what_the_library_gives(spark, tmp_path, part_rows):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library, all_rows = Tokenizer.from_file(path), rows(spark)
    root = f"file://{tmp_path}/out"
    parts = write_sequences(awkward(documents(spark, all_rows)), root, path, end_id=2, length=64, part_rows=part_rows)
    got = read_digests(spark, parts, root).orderBy("start").collect()
    start = 0
    for r, (i, t) in zip(got, sorted(all_rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")), strict=True):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        crc = zlib.crc32(b"".join(n.to_bytes(4, "little") for n in ids))
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids), crc)
        start += len(ids)
    # Random access: every sequence has its full length, and the ends mask has one bit per document.
    ends = 0
    for p in parts.collect():
        seq, _ = open_part(root, p.part)
        total = sum(seq.get_batch(k).num_rows for k in range(seq.num_record_batches))
        stream = [n for _, ids in documents_in(root, p.part) for n in ids.tolist()]
        assert len(stream) == p.total and total == -(-p.total // 64)
        for i in range(total):
            ids, mask = sequence(seq, i)
            assert len(ids) == len(mask) == 64
            assert ids.tolist()[:p.total - 64 * i] == stream[64 * i:64 * (i + 1)]
            ends += int(mask.sum())
    assert ends == len(all_rows)


def test_store_makes_room(monkeypatch):
    import pyarrow as pa

    from heliopath.llm import bpe_counts, token_files

    monkeypatch.setattr(token_files, "STORE", 20)
    monkeypatch.setattr(bpe_counts, "STORE", 20)
    path = public_tokenizers.path("byte_bpe_50k.json")
    library, encoder = Tokenizer.from_file(path), token_files.ChunkEncoder(path, 2)
    words = bpe_counts.WordCounts(public_tokenizers.path("word_bpe_49k.json"))
    other = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for k in range(30):
        texts = [f"the of the w{k} w{k + 1} and{k % 3}, the" for _ in range(3)] + [f"u{k}x{j}" for j in range(15)]
        ids, counts = encoder.of(pa.array(texts))
        want = [[*library.encode(t, add_special_tokens=False).ids, 2] for t in texts]
        assert ids.tolist() == sum(want, []) and counts.tolist() == list(map(len, want))
        assert words.of([t.encode() for t in texts]).tolist() == [len(other.encode(t, add_special_tokens=False).ids) for t in texts]


def test_empty_table(spark, tmp_path):
    assert token_counts(documents(spark, []), public_tokenizers.path("word_bpe_49k.json"), 5).count() == 0
    parts = write_sequences(documents(spark, []), f"{tmp_path}/none", public_tokenizers.path("byte_bpe_50k.json"), 2)
    assert read_digests(spark, parts, f"{tmp_path}/none").count() == 0


def test_a_worker_lets_go_of_what_it_has_loaded():
    from heliopath.llm.tables import LOADED, let_go, per_worker

    calls = []
    load = per_worker(lambda name: calls.append(name) or [name])
    try:
        assert load("a") is load("a") and calls == ["a"]
        let_go()
        assert load("a") == ["a"] and calls == ["a", "a"]
    finally:
        LOADED.remove(load)
