import random
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from heliopath.llm import repeats
from heliopath.llm.repeats import cut_texts, least_behind, repeated_suffixes, text_key

from .helpers import awkward, documents


def plain_cuts(texts, depth):
    """(n_bytes, spans, kept) of every text, from a table of all windows."""
    datas = [(t or "").encode() for t in texts]
    seen = {}
    for d in datas:
        for i in range(len(d) - depth + 1):
            seen[d[i:i + depth]] = seen.get(d[i:i + depth], 0) + 1
    out = []
    for d in datas:
        covered = bytearray(len(d))
        for i in range(len(d) - depth + 1):
            if seen[d[i:i + depth]] > 1:
                covered[i:i + depth] = b"\1" * depth
        edges = [i for i in range(len(d) + 1) if (i < len(d) and covered[i]) != (i > 0 and covered[i - 1])]
        out.append((len(d), [tuple(edges[i:i + 2]) for i in range(0, len(edges), 2)],
                    bytes(b for b, c in zip(d, covered) if not c)))
    return out


def cuts(spark, texts, depth):
    rows = list(enumerate(texts))
    docs = awkward(documents(spark, rows))
    made = docs.select("doc_id", text_key().alias("own")).join(cut_texts(docs, depth), F.col("own") == F.col("key"))
    got = {r.doc_id: (r.n_bytes, [tuple(s) for s in r.spans], bytes(r.kept)) for r in made.collect()}
    return [got[i] for i in range(len(rows))]


def corpus(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdeé", k=rng.randrange(1, 9))) for _ in range(3000)]
    text = lambda n: " ".join(rng.choices(words, k=n))
    shared = [text(30), text(90), text(33)]
    out = [None, "", "a", "a" * 199, "a" * 200, "b" * 201, "xyz" * 150, "語" * 80]
    for _ in range(60):
        out.append(text(rng.randrange(1, 60)))
        out.append(text(rng.randrange(30)) + rng.choice(shared) + text(rng.randrange(30)))
        s = rng.choice(shared)
        b, e = sorted((rng.randrange(len(s)), rng.randrange(len(s))))
        out.append(text(20) + s[b:e] + text(5) + s[:b])
    base = text(200).split(" ")
    for _ in range(20):
        own = list(base)
        own[rng.randrange(200)] = "other"
        out.append(" ".join(own))
    out += [base[0] * 400, text(80) * 3] + [out[9]] * 3 + [out[20]] * 2
    return out


@pytest.mark.parametrize("seed, most, rows, chunk", [(1, 10_000, 10_000, 1 << 19), (2, 2, 10_000, 700), (3, 5, 7, 3000)])
def test_agrees_with_all_windows(spark, monkeypatch, seed, most, rows, chunk):
    for name, value in (("MOST", most), ("OPEN", rows), ("CHUNK", chunk)):
        monkeypatch.setattr(repeats, name, value)
    texts = corpus(seed)
    assert cuts(spark, texts, 200) == plain_cuts(texts, 200)


def test_other_depths(spark):
    texts = corpus(5)[:120]
    for depth in (41, 77):
        assert cuts(spark, texts, depth) == plain_cuts(texts, depth)


def test_passes_leave_equal_suffixes_only():
    rng = np.random.default_rng(3)
    data = rng.integers(0, 3, 4000).astype(np.uint8)
    first = np.arange(len(data) - 13)
    marks = repeated_suffixes(data, first, np.zeros(len(first), np.int64), 2, 5)
    held = [data[i:i + 13].tobytes() for i in first]
    assert marks.tolist() == [held.count(x) > 1 for x in held]
    values = rng.integers(0, 99, 50)
    for width in (1, 2, 5, 8, 13):
        assert least_behind(values, width).tolist() == [values[i:i + width].min() for i in range(51 - width)]


def test_very_long_text_and_empty_table(spark):
    rng = random.Random(8)
    passage = "".join(rng.choices("abcdefgh ", k=300))
    long = "".join(rng.choices("abcdefgh ", k=1_500_000)) + passage
    texts = [long, "q" + passage + "z"]
    got = cuts(spark, texts, 200)
    assert [s for _, s, _ in got] == [[(1_500_000, 1_500_300)], [(1, 301)]]
    assert cut_texts(documents(spark, [])).count() == 0


def test_query(spark):
    from heliopath.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = {r.doc_id: (n, sum(e - b for b, e in s), len(s), sha256(k).hexdigest())
            for r, (n, s, k) in zip(docs, plain_cuts([r.text for r in docs], 200))}
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in QUERIES["op12_repeated_bytes"](spark, sf).collect()}
    assert got == want
