import math
import random

import numpy as np
import pytest

import corpus_pipeline
from heliopath.llm import near_copies
from heliopath.llm.covering import fingerprint
from heliopath.llm.near_copies import half_masks, shingles, without_near_copies

from .helpers import awkward, documents

WORDS = [f"w{i}" for i in range(4000)]


def family(rng, n, length, changed):
    base = rng.choices(WORDS, k=length)
    out = [base]
    for _ in range(n - 1):
        own = list(base)
        for at in rng.sample(range(length), changed):
            own[at] = rng.choice(WORDS)
        out.append(own)
    return [" ".join(w) for w in out]


def plain_kept(rows, radius=13):
    """Least id of every component over all pairs within the radius and as similar."""
    sets, fps = [shingles((t or "").encode(), 5) for _, t in rows], [fingerprint((t or "").encode(), 5) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius and (
                    sets[i] == sets[j] or len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8):
                root[top(i)] = top(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(top(i), []).append(d)
    return sorted(min(g) for g in groups.values())


def corpus(seed):
    rng, texts = random.Random(seed), []
    for _ in range(30):
        texts += family(rng, 4, rng.choice([60, 150, 400]), rng.choice([1, 2, 4, 8]))
    texts += family(rng, 60, 200, 3) + [None, "", "a b", "a b", "A  B", "a c"]
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_masks_cover_thirteen_bits():
    masks, rng = half_masks(13), random.Random(1)
    assert len(masks) == 254 and sorted({m.bit_count() for m in masks}) == [12, 16, 20, 32]
    for _ in range(3000):
        differ = sum(1 << i for i in rng.sample(range(64), 13))
        assert any(not differ & m for m in masks)


@pytest.mark.parametrize("few, dense", [(16, 8), (2, 0), (2, 0.5)])
def test_agrees_with_all_pairs(spark, few, dense, monkeypatch):
    monkeypatch.setattr(near_copies, "FEW", few)
    monkeypatch.setattr(near_copies, "DENSE", dense)
    rows = corpus(3)
    got = without_near_copies(awkward(documents(spark, rows)))
    assert got.columns == awkward(documents(spark, [])).columns
    assert sorted(r.doc_id for r in got.collect()) == plain_kept(rows)


def test_stage_drops_near_copies_beyond_three_bits(spark):
    """Copies of similarity 0.8 and more go although their fingerprints differ in 4 to 11 bits; others stay."""
    rng, rows, gone = random.Random(7), [], 0
    while gone < 12:
        a, b = family(rng, 2, 200, 3)
        apart = (fingerprint(a.encode(), 5) ^ fingerprint(b.encode(), 5)).bit_count()
        if 4 <= apart <= 11:
            rows += [(2 * gone, a), (2 * gone + 1, b)]
            gone += 1
    loose = family(rng, 2, 200, 12)  # about 0.5
    rows += [(100, loose[0]), (101, loose[1])]
    kept = corpus_pipeline.drop_near_duplicates(spark, documents(spark, rows), "").collect()
    assert sorted(r.doc_id for r in kept) == [*range(0, 24, 2), 100, 101]


def test_forest_joins_what_is_close():
    rng = np.random.default_rng(2)
    fps, nodes = rng.integers(0, 1 << 8, 50).astype(np.uint64), np.arange(50)
    pairs = near_copies.forest_pairs(fps, nodes, near_copies.Close(2, 0.8))
    assert pairs.shape[1] < 50 and (np.bitwise_count(fps[pairs[0]] ^ fps[pairs[1]]) <= 2).all()


def test_counts_that_cannot_fit_are_no_candidates():
    close, fps = near_copies.Close(64, 0.8), np.zeros(1, np.uint64)
    number = lambda size: np.array([math.floor(math.log(size) * near_copies.LOG_STEP) << near_copies.LOG_SHIFT])
    for n in range(1, 400):
        for m in range(n, 2 * n):
            if 0.8 * m <= n:
                assert close(fps, number(n), fps, number(m))[0]
    assert not close(fps, number(100), fps, number(130))[0]


def test_lookalikes_give_few_candidates(spark, monkeypatch):
    """3,000 texts of 40 words with one word replaced each: no two are similar, and few are compared."""
    base, compared = [f"b{i}" for i in range(40)], []
    rows = []
    for i in range(3000):
        own = list(base)
        own[4 + i % 32] = f"x{i}"  # five shingles of 36: two texts share 31 of 41 at most
        rows.append((i, " ".join(own)))
    plain = near_copies.similar

    def counted(pairs, *rest):
        compared.append(pairs.count())
        return plain(pairs, *rest)

    monkeypatch.setattr(near_copies, "similar", counted)
    got = {r.doc_id for r in without_near_copies(documents(spark, rows)).collect()}
    assert len(got) == len(rows)
    assert sum(compared) < 20 * len(rows)


@pytest.mark.parametrize("sets", [512, 20])
def test_links_of_a_large_group_are_a_forest(spark, sets, monkeypatch):
    """250 texts of one base, up to two words replaced: all links are kept, but not as all pairs; 20: long texts, all pairs."""
    monkeypatch.setattr(near_copies, "SETS", sets)
    rng, base, rows = random.Random(4), [f"b{i}" for i in range(150)], []
    for i in range(250):
        own = list(base)
        for at in rng.sample(range(5, 145), 1 + i % 2):
            own[at] = f"x{rng.randrange(40)}"
        rows.append((i, " ".join(own)))
    rows = [(i, t) for i, t in dict((t, i) for i, t in rows).items()]
    held = {i: shingles(t.encode(), 5) for t, i in rows}
    links = [(a, b) for a in held for b in held if a < b and len(held[a] & held[b]) >= 0.8 * len(held[a] | held[b])]
    nodes = spark.createDataFrame([(i, 0, i, t) for t, i in rows], "node long, fp long, root long, text string")
    pairs = near_copies.prefix_pairs(nodes, near_copies.Close(13, 0.8), 5, 0.8)
    texts = nodes.select("node", "text")
    found = near_copies.similar(near_copies._in_order(pairs), texts, 5, 0.8)
    groups = lambda some: {r.node: r.root for r in near_copies.components(spark.createDataFrame(some, "a long, b long")).collect()}
    assert groups(found.collect()) == groups(links)
    tokens = sum(len(s) - math.ceil(0.8 * len(s)) + 1 for s in held.values())
    assert len(links) > tokens
    assert sets == 20 or pairs.count() < tokens


def test_recall_over_all_pairs_of_the_test_table(spark):
    """Of all pairs of different texts of 0.8 and more, with no bound on bits, nine in ten are in one group."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    texts = {}
    for d, t in sorted(docs.collect()):
        texts.setdefault(b" ".join((t or "").encode().lower().split()), d)
    sets, having = {d: shingles(t, 5) for t, d in texts.items()}, {}
    for d, own in sets.items():
        for s in own:
            having.setdefault(s, []).append(d)
    shared = {}
    for ids in having.values():
        for i, a in enumerate(ids):
            for b in ids[:i]:
                shared[a, b] = shared.get((a, b), 0) + 1
    pairs = {p: n / (len(sets[p[0]]) + len(sets[p[1]]) - n) for p, n in shared.items()}
    pairs = {p: j for p, j in pairs.items() if j >= 0.8}
    fps = {d: fingerprint(t, 5) for t, d in texts.items()}
    for least in (0.8, 0.85, 0.9):
        own = [p for p, j in pairs.items() if j >= least]
        print(least, len(own), [sum((fps[a] ^ fps[b]).bit_count() <= r for a, b in own) for r in (3, 11, 13, 15)])
    held = {r.doc_id for r in without_near_copies(docs).collect()}
    assert sum(not {a, b} <= held for a, b in pairs) >= 0.9 * len(pairs) > 0


def test_empty_table(spark):
    assert without_near_copies(documents(spark, [])).count() == 0
