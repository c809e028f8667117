import hashlib
from collections import defaultdict

from heliopath.llm.mixing import mix, mixed

from .helpers import awkward, documents, words


def plain_targets(sizes):
    """Iterated sharing: what stands above its limit is cut back, the rest is shared again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    target, open_ = {}, set(order)
    while open_:
        rest = sum(sizes.values()) - sum(target.values())
        share = {s: rest * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = {s for s in open_ if share[s] >= 3 * sizes[s]}
        if not over:
            return {**target, **share}
        target |= {s: 3.0 * sizes[s] for s in over}
        open_ -= over
    return target


def rows_of(spread):
    rows, i = [], 0
    for source, lengths in spread.items():
        for n in lengths:
            rows.append((i, " ".join(["w"] * n) if n else None, "en", source))
            i += 1
    return rows


SPREAD = {"b": [5, 7, 900, 3] * 10, "a": [1, 0, 2], "c": [10] * 30, None: [4, 4], "é": [50], "Z": [3] * 8, "empty": [0, 0]}


def test_targets_and_cuts(spark):
    rows = rows_of(SPREAD)
    got = mix(awkward(documents(spark, rows)), ["doc_id", "source"]).collect()
    sizes = {s: sum(v) for s, v in SPREAD.items()}
    targets, taken = plain_targets(sizes), defaultdict(int)
    assert len(got) == len(rows)
    for r in got:
        assert r.source_size == sizes[r.row.source]
        assert abs(r.target - targets[r.row.source]) < 1e-6
        assert 0 <= r.taken <= 3 * r.size
        assert r.taken == r.epochs * r.size + r.cut and (r.cut < r.size or r.cut == 0)
        taken[r.row.source] += r.taken
    for s, t in targets.items():
        assert abs(taken[s] - t) < 1 + 1e-6
    # Within a source, rows are taken in the order of their keys.
    for s in sizes:
        own = sorted((r for r in got if r.row.source == s and r.size),
                     key=lambda r: hashlib.md5(str(r.row.doc_id).encode()).hexdigest())
        share = [r.taken / r.size for r in own]
        assert share == sorted(share, reverse=True)


def test_reruns_agree_and_partitions_do_not_matter(spark):
    rows = rows_of(SPREAD)
    a = mix(documents(spark, rows, 1), ["doc_id"]).collect()
    b = mix(documents(spark, rows, 7), ["doc_id"]).collect()
    key = lambda r: (r.row.doc_id, r.taken)
    assert sorted(map(key, a)) == sorted(map(key, b))


def test_mixed_rows_hold_the_words_taken(spark):
    rows = [(1, "  one two\n three four ", "en", "a"), (2, "five", "en", "b"), (3, "six seven\teight", "en", "b"),
            (1, "  one two\n three four ", "en", "a"), (None, None, None, None), (5, "", "en", "c")]
    docs = documents(spark, rows)
    plan, out = mix(docs, ["doc_id"]).collect(), mixed(docs)
    assert out.columns == docs.columns
    assert sum(len(words(r.text)) for r in out.collect()) == sum(r.taken for r in plan)
    whole = {r[1] for r in rows if r[1]}
    assert all(any(w.startswith(r.text) for w in whole) for r in out.collect())


def test_empty_table(spark):
    assert mix(documents(spark, []), ["doc_id"]).count() == 0
    only_empty = mix(documents(spark, [(1, None), (2, "")]), ["doc_id"]).collect()
    assert [(r.target, r.taken) for r in only_empty] == [(0.0, 0), (0.0, 0)]
