import random
from hashlib import sha256

import pytest

from heliopath.llm.fill_middle import BlockTree, fill_in_middle, restored

from .helpers import awkward, documents

ODD = [(1, None), (2, ""), (3, "a"), (None, "null id, wörds"), (None, None), (5, "has <P> in it"), (6, "has <S>"), (7, "<M>"),
       (8, "<<S<P<M" * 3), (8, "<<S<P<M" * 3), (9, "日本語 😀 text\nlines\n\n  more"), (10, "x\n" * 9000 + "é" * 9000)]


def plain_rule(key, text):
    """The rule over code points, word for word."""
    text, digest = text or "", sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i:i + 8], 16) for i in (0, 8, 16, 24))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"
    return n, "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"


def corpus():
    rng = random.Random(4)
    return ODD + [(i, "".join(rng.choices("ab <>PSM\nä語😀", k=rng.choice([1, 3, 40, 5000])))) for i in range(20, 160)]


def test_agrees_with_plain_rule(spark):
    rows = corpus()
    cut = fill_in_middle(awkward(documents(spark, rows)), ["doc_id", "text", "row", "key"])
    got = cut.withColumn("back", restored(cut.output, cut.form)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_units, r.form, r.prefix_chars, r.middle_chars, r.output) == plain_rule(r.row.doc_id, r.row.text)
        assert r.back == (r.row.text or "")
    assert {r.form for r in got} == {"plain", "psm", "spm"}


@pytest.mark.parametrize("unit, cut", [
    ("word", lambda t: [m.group() for m in __import__("re").finditer(r"[^ \t-\r]+[ \t-\r]*|^[ \t-\r]+", t)]),
    ("line", lambda t: t.splitlines(keepends=True)), ("code point", list)])
@pytest.mark.parametrize("block", [1, 7, 4096])
def test_tree_finds_every_unit(unit, cut, block):
    rng = random.Random(9)
    for _ in range(30):
        text = "".join(rng.choices("ab  \nä語", k=rng.randrange(60)))
        pieces, tree = cut(text), BlockTree(text.encode(), unit, block)
        assert tree.units == len(pieces)
        for k in range(len(pieces) + 2):
            before = "".join(pieces[:k])
            assert tree.find(k) == (len(before.encode()), len(before))


def test_words_and_lines_come_back_whole(spark):
    rows = [(i, "  one two\nthree  four\n\nfive ") for i in range(60)]
    for unit in ("word", "line"):
        cut = fill_in_middle(documents(spark, rows), ["doc_id"], unit=unit, percent=100)
        assert all(r.back == rows[0][1] for r in cut.select(restored(cut.output, cut.form).alias("back")).collect())


def test_very_long_text_and_empty_table(spark):
    text = "ab語 " * 400_000
    got = fill_in_middle(documents(spark, [(4, text)]), ["doc_id"]).first()
    assert (got.n_units, got.form, got.prefix_chars, got.middle_chars, got.output) == plain_rule(4, text)
    assert fill_in_middle(documents(spark, []), ["doc_id"]).count() == 0
