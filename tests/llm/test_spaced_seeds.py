import random

from heliopath.llm.spaced_seeds import MASKS, PLAIN_WORDS, leaks, without_leaks

from .helpers import awkward, documents

WORDS = [f"w{i}" for i in range(3000)]


def plain_words(text):
    return PLAIN_WORDS((text or "").encode().lower())


def plain_best(doc, item, least=8, share=0.5):
    """The best stretch over all ways to lay the item over the document; 1 a match, -4 a substitution."""
    d, t, best = plain_words(doc), plain_words(item), None
    for shift in range(-len(t) + 1, len(d)):
        low, high = max(0, -shift), min(len(t), len(d) - shift)
        same = [t[k] == d[k + shift] for k in range(low, high)]
        top = None
        for a in range(len(same)):
            score = 0
            for b in range(a, len(same)):
                score += 1 if same[b] else -4
                if score > 0 and (top is None or score > top[0]):
                    top = (score, b + 1 - a, sum(same[a:b + 1]))
        if top and top[1] >= max(least, share * len(t)) and (best is None or top[2] > best[1]):
            best = top[1:]
    return best


def case(seed):
    rng = random.Random(seed)
    items = [(i, " ".join(rng.choices(WORDS, k=rng.choice([3, 12, 25, 60])))) for i in range(25)]
    items += [(25, None), (26, ""), (27, items[1][1]), (28, "one two")]
    docs = []
    for i in range(60):
        w = rng.choices(WORDS, k=rng.choice([0, 4, 50, 300]))
        if rng.random() < 0.6:
            planted = rng.choice(items)[1] or ""
            p = planted.split()
            for k in range(len(p)):
                if rng.random() < rng.choice([0, 0.1]):
                    p[k] = rng.choice(WORDS)
            cut = rng.choice([0, 0, len(p) // 4, len(p) // 2, 3 * len(p) // 4])
            at = rng.randrange(len(w) + 1)
            w[at:at] = [x.upper() + "," if rng.random() < 0.2 else x for x in p[cut:]]
        docs.append((i, " ".join(w)))
    return [*docs, (60, None), (61, ""), (None, items[2][1]), docs[3]], items


def test_agrees_with_every_overlay(spark):
    rows, items = case(3)
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, fp string")
    want = []
    for d, text in rows:
        for i, item in items:
            if len(plain_words(item)) >= 5 and (best := plain_best(text, item)):
                want.append((d, i, *best))
    for block_words in (500_000, 60):
        got = leaks(awkward(documents(spark, rows)), bench, block_words=block_words).collect()
        assert sorted(((r.doc_id, r.item_id, r.overlap, r.equal) for r in got), key=repr) == sorted(want, key=repr)
        kept = without_leaks(awkward(documents(spark, rows)), bench, block_words=block_words)
        gone = {d for d, *_ in want}
        assert sorted((r.doc_id for r in kept.collect() if r.doc_id is not None)) == sorted(d for d, _ in rows if d not in gone and d is not None)
        assert kept.columns == awkward(documents(spark, rows)).columns
    assert len(want) > 12


def test_masks_survive_regular_substitutions(spark):
    """Every third, fourth or fifth word replaced still hits."""
    for step in (3, 4, 5, 6):
        words = [f"a{k}" for k in range(40)]
        changed = [f"z{k}" if k % step == step - 1 else w for k, w in enumerate(words)]
        hit = any(all(m == "0" or words[at + k] == changed[at + k] for k, m in enumerate(mask))
                  for mask in MASKS for at in range(40 - len(mask) + 1))
        assert hit


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b c d e f g h i")], "item_id long, text string")
    docs = documents(spark, [(1, "a b c d e f g h i")])
    assert leaks(docs, none).count() == 0 and without_leaks(docs, none).count() == 1
    assert leaks(documents(spark, []), some).count() == 0
    assert leaks(docs, some).count() == 1 and without_leaks(docs, some).count() == 0


def test_short_items_and_regular_substitutions_leak(spark):
    """Items of 5 to 10 words, whole or with any one word replaced, and longer ones with every fifth word replaced."""
    rng = random.Random(5)
    items, docs, want = [], [], set()
    for n in range(5, 11):
        own = [f"s{n}x{k}" for k in range(n)]
        items.append((n, " ".join(own)))
        holes = [None, *range(n)]
        for hole in holes:
            changed = ["other" if k == hole else w for k, w in enumerate(own)]
            want.add((len(docs), n))
            docs.append((len(docs), " ".join([*rng.choices(WORDS, k=9), *changed, *rng.choices(WORDS, k=9)])))
        docs.append((len(docs), " ".join([*rng.choices(WORDS, k=9), *own[:n // 2], "x", "y", "z", *rng.choices(WORDS, k=9)])))
    for n in (15, 20, 40, 61):
        own = [f"l{n}x{k}" for k in range(n)]
        items.append((n, " ".join(own)))
        want.add((len(docs), n))
        docs.append((len(docs), " ".join([*rng.choices(WORDS, k=9), *("other" if k % 5 == 4 else w for k, w in enumerate(own)), "end"])))
        if n > 15:
            docs.append((len(docs), " ".join(["begin", *("other" if k % 4 == 3 else w for k, w in enumerate(own)), "end"])))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = leaks(documents(spark, docs), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)
    assert all(5 * r.equal >= 4 * r.overlap for r in got)
    assert {r.doc_id for r in without_leaks(documents(spark, docs), bench).collect()} == {d for d, _ in docs} - {d for d, _ in want}
