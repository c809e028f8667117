import random

import numpy as np
import pytest
import xxhash

from heliopath.llm import covering
from heliopath.llm.components import components

from .helpers import awkward, documents, words

VOCABULARY = [f"w{i}" for i in range(500)]


def plain_fingerprint(text):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    w = words(low)
    shingles = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows, radius=3):
    fps = [(i, plain_fingerprint(t)) for i, t in rows]
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for a in range(len(fps)):
            for b in range(a):
                if (fps[a][1] ^ fps[b][1]).bit_count() <= radius and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    least = {}
    for (i, _), c in zip(fps, label):
        if i is not None:
            least[c] = min(i, least.get(c, i))
    return sorted(((i, f, least.get(c)) for (i, f), c in zip(fps, label)), key=repr)


def copies(seed, n=90):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.6:
            w = (rng.choice(rows)[1] or "").split(" ")
            for _ in range(rng.choice([0, 1, 1, 2])):
                w[rng.randrange(len(w))] = rng.choice(VOCABULARY)
            rows.append((i, " ".join(w)))
        else:
            rows.append((i, " ".join(rng.choices(VOCABULARY, k=rng.choice([1, 2, 3, 30, 300])))))
    rows += [(n, None), (n + 1, ""), (n + 2, " \t\n"), (None, rows[0][1]), (None, "only here"), rows[3], (n + 3, "ÉA b"),
             (n + 4, "Éa B")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("most", [4096, 12])
def test_agrees_with_all_pairs(spark, most, monkeypatch):
    rows = copies(7)
    links = covering.near_links
    monkeypatch.setattr(covering, "near_links", lambda fps, radius: links(fps, radius, most))
    got = covering.near_duplicates(awkward(documents(spark, rows))).collect()
    assert sorted(((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in got), key=repr) == plain_components(rows)


def test_masks_cover_every_small_difference():
    from itertools import combinations

    for family in (1, 2):
        masks = [m & (1 << 64) - 1 for m in covering.covering_masks(3, family)]
        assert len(masks) == 15
        for where in combinations(range(64), 3):
            assert any(not m & sum(1 << i for i in where) for m in masks)


def test_crowded_buckets_lose_no_link(spark):
    """One bucket in every table holds all: a family that differs in few positions only."""
    rng = np.random.default_rng(5)
    places = rng.choice(64, 9, replace=False)
    fps = {0}
    for _ in range(400):
        fps.add(sum(1 << int(p) for p in rng.choice(places, rng.integers(1, 8), replace=False)))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    links = covering.near_links(spark.createDataFrame([(f,) for f in signed], "fp long"), most=16)
    found = {r.node: r.root for r in components(links).collect()}
    want = plain_roots(sorted(fps))
    groups = lambda labels: {frozenset(k for k in labels if labels[k] == v) for v in labels.values()}
    unsigned = {k & (1 << 64) - 1: v for k, v in found.items()}
    unsigned |= {f: ("alone", f) for f in fps if f not in unsigned}
    assert groups(unsigned) == groups(want)


def plain_roots(fps):
    label = {f: f for f in fps}
    for a in fps:
        for b in fps:
            if (a ^ b).bit_count() <= 3 and label[a] != label[b]:
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = {k: new if v == old else v for k, v in label.items()}
    return label


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (5, 5)], "a long, b long")
    got = {r.node: r.root for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def test_empty_table(spark):
    assert covering.near_duplicates(documents(spark, [])).count() == 0
