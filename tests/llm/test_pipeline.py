"""Each stage on what the one before it kept, against plain forms of its rule."""

import zlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from heliopath.llm.spaced_seeds import PLAIN_WORDS
from heliopath.llm.tables import stored, table

from .helpers import documents, words
from .test_near_copies import plain_kept

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark):
    rows, out = table(spark, SF, "documents"), []
    for _, stage in corpus_pipeline.STAGES:
        after = stored(stage(spark, rows, SF))
        out.append((rows.collect(), after.collect(), rows.columns, after.columns))
        rows = after
    return out


def test_columns(kept):
    assert len(corpus_pipeline.STAGES) == 5
    for _, _, before, after in kept[:-1]:
        assert before == after
    assert kept[-1][3] == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_quality_keeps_clean_documents(spark, kept):
    before, after, *_ = kept[0]
    assert set(after) <= set(before)
    sf = "/root/testdata/sf0.1"  # the few labels of the smaller tables do not tell texts apart
    held = {r.doc_id for r in corpus_pipeline.keep_quality(spark, table(spark, sf, "documents"), sf).collect()}
    labels = table(spark, sf, "labels").collect()
    clean, foul = ({r.doc_id for r in labels if r.quality == q and not r.toxic} for q in (1, 0))
    assert len(clean - held) <= 0.01 * len(clean) and len(foul & held) <= 0.1 * len(foul)


def test_one_document_of_each_group_stays(kept):
    before, after, *_ = kept[1]
    want = plain_kept([(r.doc_id, r.text) for r in before])
    assert sorted(r.doc_id for r in after) == want and set(after) <= set(before)


def test_leaking_documents_go(spark, kept):
    before, after, *_ = kept[2]
    items = [PLAIN_WORDS(r.text.lower().encode()) for r in table(spark, SF, "benchmark").collect()]
    joined = [b" " + b" ".join(i) + b" " for i in items]
    whole = lambda r: b" " + b" ".join(PLAIN_WORDS((r.text or "").lower().encode())) + b" "
    held = {r.doc_id for r in after}
    for r in before:
        assert (r.doc_id in held) == (not any(i in whole(r) for i in joined))


def test_mix_repeats_rows_of_its_input(kept):
    before, after, *_ = kept[3]
    text = {r.doc_id: r.text for r in before}
    total = sum(len(words(r.text)) for r in before)
    assert abs(sum(len(words(r.text)) for r in after) - total) <= len({r.source for r in before})
    assert all((text[r.doc_id] or "").startswith(r.text) for r in after)


def test_token_files_hold_the_mix(kept):
    before, after, *_ = kept[4]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for r in before:
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 2]
        want.append((r.doc_id, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))))
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in after) == sorted(want)
    at = 0
    for r in sorted(after, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens


def test_run_gives_the_last_stage(spark, kept):
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, kept[-1][1]))


def test_awkward_and_empty_tables(spark):
    odd = documents(spark, [(1, None, None, None), (None, "a b", "en", "s"), (2, "", "en", "s"), (2, "", "en", "s"), (3, "w " * 30_000, "en", "s")])
    for docs, least in ((odd, 1), (documents(spark, []), 0)):
        for _, stage in corpus_pipeline.STAGES:
            docs = stored(stage(spark, docs, SF))
        assert docs.count() >= least
