import math
import random
import zlib
from collections import Counter

from heliopath.llm import context_trees
from heliopath.llm.context_trees import score_texts

from .helpers import awkward, documents

DEPTH = 3


def stream_of(text):
    words = (text or "").encode().lower().split()
    return b" ".join(words) + b"\n", [*words, b"\n"]


def plain_scores(rows, depth=DEPTH):
    """Trees as dictionaries of (context, node) -> [zeros, ones], mixed by recursion."""
    counts, words = {}, Counter()
    held = {i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0 for i, _ in rows}
    for i, t in rows:
        if not held[i]:
            stream, own = stream_of(t)
            words.update(own)
            padded = b"\n" * depth + stream
            for at in range(depth, len(padded)):
                for d in range(depth + 1):
                    node = 1
                    for k in range(7, -1, -1):
                        bit = padded[at] >> k & 1
                        counts.setdefault((padded[at - d:at], node), [0, 0])[bit] += 1
                        node = 2 * node + bit
    children = {}
    for context, node in counts:
        if context:
            children.setdefault((context[1:], node), []).append((context, node))
    kt, pw = {}, {}
    for key in sorted(counts, key=lambda k: -len(k[0])):
        a, b = counts[key]
        kt[key] = math.lgamma(a + .5) + math.lgamma(b + .5) - math.lgamma(a + b + 1) - math.log(math.pi)
        if len(key[0]) == depth:
            pw[key] = kt[key]
        else:
            below = sum(pw[c] for c in children[key])
            m = max(kt[key], below)
            pw[key] = math.log(.5) + m + math.log(math.exp(kt[key] - m) + math.exp(below - m))

    def chance(context, node, bit):
        key = (context, node)
        if key not in counts:
            return None
        own = (counts[key][bit] + .5) / (sum(counts[key]) + 1)
        if len(context) == depth:
            return own
        return own, .5 * math.exp(kt[key] - pw[key])

    out, total, kinds = [], sum(words.values()), len(words)
    for i, t in rows:
        stream, own = stream_of(t)
        padded, score = b"\n" * depth + stream, 0.0
        for at in range(depth, len(padded)):
            node = 1
            for k in range(7, -1, -1):
                bit, p = padded[at] >> k & 1, None
                for d in range(depth, -1, -1):
                    found = chance(padded[at - d:at], node, bit)
                    if found is not None:
                        if d == depth:
                            p = found
                        else:
                            p = found[0] if p is None else found[1] * found[0] + (1 - found[1]) * p
                score += math.log10(.5 if p is None else p)
                node = 2 * node + bit
        base = sum(math.log10((words[w] + .1) / (total + .1 * (kinds + 1))) for w in own) if total else 0.0
        out.append((i, held[i], len(own), sum(words[w] > 0 for w in own), total, round(base, 6), round(score, 6)))
    return sorted(out, key=repr)


def corpus(seed, n=40):
    rng = random.Random(seed)
    words = ["the", "of", "Theatre", "thing", "é", "other", "a", "mother", "bring"]
    rows = [(i, "  ".join(rng.choices(words, k=rng.choice([0, 1, 5, 40])))) for i in range(n)]
    return rows + [(n, None), (n + 1, ""), (n + 2, "unheard zzz <>"), (None, "the of"), rows[5]]


def test_agrees_with_recursion(spark, monkeypatch):
    rows = corpus(1)
    for block in (24_000_000, 300):
        monkeypatch.setattr(context_trees, "BLOCK_BYTES", block)
        got = score_texts(awkward(documents(spark, rows)), depth=DEPTH).collect()
        assert sorted((tuple(r[:5]) + (round(r.base_score, 6), round(r.score, 6)) for r in got), key=repr) == plain_scores(rows)
        assert all(abs(r.bits_per_byte * r.n_bytes * math.log10(2) + r.score) < 1e-9 * (1 - r.score) for r in got)


def test_held_out_texts_score_above_the_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = score_texts(docs).filter("held_out").selectExpr("sum(score) s", "sum(base_score) b", "count(*) n").first()
    assert held.n > 50 and held.s > held.b


def test_chances_of_all_bytes_sum_to_one():
    import numpy as np

    from heliopath.llm.context_trees import Trees, grams_of, shallow_depths

    grams, _ = grams_of([b"abracadabra\n", b"abc\n"], DEPTH)
    distinct, times = np.unique(grams, return_counts=True)
    trees = Trees(distinct, times, DEPTH)
    shallow = shallow_depths(zip(*[v.tolist() for v in trees.sums()]))
    for context in (b"abr", b"zzz", b"cab"):
        base = int.from_bytes(context, "big") << 8
        every = np.array([base | b for b in range(256)], np.uint64)
        assert abs((10 ** trees.log10(every, shallow)).sum() - 1) < 1e-9


def test_empty_and_untrained_tables(spark):
    assert score_texts(documents(spark, [])).count() == 0
    alone = score_texts(documents(spark, [(None, "a b")])).first()
    assert (alone.held_out, alone.n_tokens, alone.n_known, alone.train_tokens) == (True, 3, 0, 0)
    assert abs(alone.bits_per_byte - 8) < 1e-9
