import math
import random
import zlib
from collections import Counter

import pytest

from heliopath.llm import resampling, risk_rules

from .helpers import awkward, documents, words

GOOD = [f"g{i}" for i in range(300)]


def labelled(spark, n=1500, seed=2):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        bad = rng.random() < 0.2
        own = [rng.choice(GOOD) for _ in range(rng.choice([15, 40, 90]))]
        if bad:
            own = [w + rng.choice(["###", "%%%", "$$$"]) for w in own]
        rows.append((i, " ".join(own), "en" if i % 3 else "de", "s"))
        if i % 2:
            labels.append((i, int(not bad), 0))
    rows += [(n, None), (n + 1, ""), (None, "a b c"), rows[1], rows[0]]
    labels += [(10 ** 9, 1, 0), (None, 1, 0), (1, 0, 0)]
    return rows, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), dict((a, b) for a, b, _ in labels)


def plain_repeats(w):
    n = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    return len({j for i in range(len(w) - 4) if n[tuple(w[i:i + 5])] > 1 for j in range(i, i + 5)})


def plain_signals(text):
    text = text or ""
    w = words(text)
    lines = [x for x in text.split("\n") if words(x)]
    return (len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), plain_repeats(w))


def test_signals():
    rng = random.Random(4)
    texts = ["", " \n ", "a b a b a b a b a b", "é# é#\né# é#\n\n \té# é#", "x y a\x1cb c\x85d", "a b c d e a b c d e f", "a b c d"]
    for k in (2, 8, 30):
        texts += ["\n".join(" ".join(rng.choices(GOOD[:k], k=7)) for _ in range(rng.randrange(60))) for _ in range(15)]
    texts.append(" ".join(rng.choices([f"n{i}" for i in range(9000)], k=20_000)) * 2)
    for t in texts:
        assert risk_rules.signals_of(t.encode())[:5] == plain_signals(t)


def test_binomial_bound():
    for k, n, p in ((0, 10, .1), (3, 50, .02), (20, 400, .1), (5, 5, .5)):
        want = sum(math.comb(n, i) * p ** i * (1 - p) ** (n - i) for i in range(k + 1))
        assert abs(risk_rules.at_most_chance(k, n, p) - want) < 1e-9
    assert risk_rules.accepted_level([0, 0, 1, 40, 0], 500, .02, .0125) == 3
    assert risk_rules.accepted_level([0, 0], 100, .02, .0125) == 0


def test_rules_reject_bad_texts_within_the_bound(spark):
    rows, labels, quality = labelled(spark, 4000)
    got = risk_rules.judge(awkward(documents(spark, rows)), awkward(labels), alpha=0.02).collect()
    assert len(got) == len(rows)
    by_text = {}
    for r in got:
        by_text.setdefault(r.doc_id, []).append(r)
    for i, t, *_ in rows:
        r = by_text[i][0]
        assert tuple(r[s] for s in risk_rules.SIGNALS[:5]) == plain_signals(t)
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)
    fine = [r for r in got if r.n_symbols == 0 and not r.base_failed]
    foul = [r for r in got if r.n_symbols > 0 and not r.base_failed]
    assert sum(not r.kept for r in fine) <= 0.02 * len(fine)
    assert sum(not r.kept for r in foul) > 0.9 * len(foul)


def test_too_few_labels_reject_nothing(spark):
    rows, labels, _ = labelled(spark, 60)
    for few in (labels, labels.limit(0)):
        got = risk_rules.judge(documents(spark, rows), few).collect()
        assert all(r.kept != r.base_failed for r in got)
    assert risk_rules.judge(documents(spark, []), labels).count() == 0


def plain_ratio(rows, wanted):
    raw, target = Counter(), Counter()
    for i, t, *_ in rows:
        bucket, _ = resampling.Features().of([(t or "").encode()])
        raw.update(bucket.tolist())
        if i in wanted:
            target.update(bucket.tolist())
    share = lambda c, b: math.log((c[b] + .5) / (sum(c.values()) + .5 * resampling.BUCKETS))
    return lambda b: share(target, b) - share(raw, b)


MADE = ["n_features", "log_weight", "word_weight", "draw_key", "selected"]


def test_weights_and_selection(spark):
    rows, labels, quality = labelled(spark)
    got = resampling.resample(awkward(documents(spark, rows)), awkward(labels), ["doc_id", "fp"], loss=0.01).select("row.*", *MADE).collect()
    assert len(got) == len(rows)
    clean = {i for i, q in quality.items() if q and i is not None}
    ratio = plain_ratio(rows, {i for i in clean if zlib.crc32(str(i).encode()) % 2 == 0})
    texts = {i: t for i, t, *_ in rows}
    for r in got[:200]:
        bucket, _ = resampling.Features().of([(texts[r.doc_id] or "").encode()])
        assert r.n_features == len(bucket) and abs(r.log_weight - sum(map(ratio, bucket.tolist()))) < 1e-6
    assert min(r.draw_key for r in got if r.selected) > max((r.draw_key for r in got if not r.selected), default=-1e9)
    bad = [r for r in got if "#" in (texts[r.doc_id] or "") or "%" in (texts[r.doc_id] or "")]
    assert sum(not r.selected for r in bad) > 0.95 * len(bad)
    unseen = [r for r in got if r.doc_id in clean and zlib.crc32(str(r.doc_id).encode()) % 2]
    assert sum(not r.selected for r in unseen) <= 0.02 * len(unseen) + 1
    again = resampling.resample(documents(spark, rows, 7), labels, ["doc_id"], loss=0.01).select("row.*", *MADE)
    key = lambda r: (str(r.doc_id), r.draw_key, r.selected)
    assert sorted(map(key, again.collect())) == sorted(map(key, got))


@pytest.mark.parametrize("k", [1, 2, 7, 500, 997])
def test_kth_largest(spark, k):
    rng = random.Random(k)
    values = [rng.choice([rng.randrange(-10 ** 9, 10 ** 9), 5, -3]) for _ in range(997)]
    assert resampling.kth_largest(spark.createDataFrame([(v,) for v in values], "q long"), k, bins=16) == sorted(values)[-k]


def test_no_labels_and_no_rows(spark):
    _, labels, _ = labelled(spark, 20)
    some = documents(spark, [(1, "a"), (2, None)])
    none = labels.limit(0)
    assert [r.selected for r in resampling.resample(some, none, ["doc_id"]).collect()] == [True, True]
    assert resampling.resample(documents(spark, []), labels, ["doc_id"]).count() == 0


def test_words_that_clean_texts_never_have_weigh_down(spark):
    """A few rude words in good long texts of many rare words: most of these rows go, clean ones stay."""
    rng, rows, labels = random.Random(9), [], []
    for i in range(3000):
        own = [rng.choice(GOOD) if rng.random() < 0.8 else f"r{rng.randrange(40_000)}" for _ in range(rng.choice([60, 200, 600]))]
        toxic = rng.random() < 0.1
        for _ in range(3 * toxic):
            own[rng.randrange(len(own))] = rng.choice(["rude", "vile", "nasty"])
        rows.append((i, " ".join(own), "en", "s"))
        if rng.random() < 0.4:
            labels.append((i, 1, int(toxic)))
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.selected for r in resampling.resample(documents(spark, rows), table, ["doc_id"]).select("row.*", *MADE).collect()}
    toxic, clean = ([got[i] for i, _, t in labels if t == k] for k in (1, 0))
    assert sum(toxic) < 0.1 * len(toxic) and sum(clean) > 0.99 * len(clean)


def test_toxic_rows_go_on_the_test_table(spark):
    """Of labelled rows of good quality most toxic ones go, and under 1 % of the clean ones."""
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    held = {r.doc_id for r in resampling.resample(docs, labels, ["doc_id"]).filter("selected").select("row.*").collect()}
    known = [(r.doc_id, r.toxic) for r in labels.filter("quality = 1").collect()]
    toxic, clean = ([i in held for i, t in known if t == k] for k in (1, 0))
    share = lambda x: sum(x) / len(x)
    print(f"kept: toxic {sum(toxic)} of {len(toxic)}, clean {sum(clean)} of {len(clean)}")
    assert share(toxic) < 0.4 and share(clean) > 0.99
