import random
import textwrap
from difflib import SequenceMatcher

from heliopath.llm import chaining
from heliopath.llm.chaining import chains, repeated_passages
from heliopath.llm.licenses import TEMPLATES, Scanner, candidate_blocks, license_findings

from .helpers import awkward, documents

WORDS = [f"w{i}" for i in range(5000)]


def planted(seed, rate=0.0, n=40, length=60):
    """Rows, and by passage the ids of the texts that hold it."""
    rng = random.Random(seed)
    passages = [rng.choices(WORDS, k=length + rng.randrange(40)) for _ in range(5)]
    rows, where = [], {}
    for i in range(n):
        w = rng.choices(WORDS, k=rng.choice([0, 3, 80, 500]))
        if rng.random() < 0.7:
            p = rng.randrange(5)
            own = [rng.choice(WORDS) if rng.random() < rate else x for x in passages[p]]
            at = rng.randrange(len(w) + 1)
            w[at:at] = own
            where.setdefault(p, set()).add(i)
        rows.append((i, " ".join(x.title() if rng.random() < .3 else x for x in w)))
    return [*rows, (n, None), (n + 1, "")], where


def groups(pairs):
    label = {}
    for a, b in pairs:
        x, y = label.setdefault(a, {a}), label.setdefault(b, {b})
        if x is not y:
            x |= y
            for k in y:
                label[k] = x
    return label


def test_planted_passages_connect_and_others_do_not(spark, monkeypatch):
    for rate, block in ((0.0, 1_000_000), (0.0, 50), (0.03, 300)):
        monkeypatch.setattr(chaining, "BLOCK_SEEDS", block)
        rows, where = planted(11, rate)
        got = repeated_passages(awkward(documents(spark, rows)), least_words=45).collect()
        found = groups((r.doc_id, r.other_id) for r in got)
        for ids in where.values():
            if len(ids) > 1:
                assert ids <= found[min(ids)]
        assert set(found) <= set().union(*(ids for ids in where.values()))
        for r in got:
            a = rows[r.doc_id][1].lower().split()[r.begin:r.end]
            b = rows[r.other_id][1].lower().split()[r.other_begin:r.other_end]
            equal = sum(m.size for m in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())
            assert min(len(a), len(b)) >= 45 and r.words == max(len(a), len(b))
            assert 0.8 * r.words <= r.equal <= equal
            if not rate:
                assert a == b


def test_exact_passage_has_exact_borders(spark):
    rng = random.Random(1)
    for length in (50, 51, 75, 300):
        p = rng.choices(WORDS, k=length)
        one, two = rng.choices(WORDS[:2000], k=33), rng.choices(WORDS[2000:], k=70)
        rows = [(1, " ".join([*one, "left", *p, "x1", *one[:9]])), (2, " ".join([*two, "right", *p, "x2", *two[:20]]))]
        r, = repeated_passages(documents(spark, rows)).collect()
        spans = {r.doc_id: (r.begin, r.end), r.other_id: (r.other_begin, r.other_end)}
        assert spans == {1: (34, 34 + length), 2: (71, 71 + length)} and r.words == r.equal == length


def test_inserted_words_are_bridged(spark):
    rng = random.Random(2)
    p = rng.choices(WORDS, k=120)
    rows = [(1, " ".join(p)), (2, " ".join([*p[:60], "new", "words", "here", *p[60:]]))]
    r, = repeated_passages(documents(spark, rows)).collect()
    assert (r.begin, r.end, r.other_begin, r.other_end) in ((0, 120, 0, 123), (0, 123, 0, 120)) and r.equal >= 115


def test_copies_and_awkward_rows(spark):
    rng = random.Random(3)
    text = " ".join(rng.choices(WORDS, k=70))
    rows = [(i, text) for i in range(12)] + [(3, text), (None, text), (50, "a b c d"), (51, None), (52, "same " * 200)]
    got = repeated_passages(documents(spark, rows, 4)).collect()
    assert 13 <= len(got) <= 26  # no clique of the 14 texts that share it
    assert set(groups((r.doc_id, r.other_id) for r in got)[0]) == {None, *range(12)}
    assert repeated_passages(documents(spark, [])).count() == 0


def best_chain(parts):
    """Quadratic form of the chain score."""
    begin, end, ob, oe, equal = parts
    order = sorted(range(len(begin)), key=lambda i: (begin[i], ob[i]))
    score = {}
    for i in order:
        before = [score[j] - chaining.GAP_COST * ((begin[i] - end[j]) + (ob[i] - oe[j]))
                  for j in score if begin[j] < begin[i] and ob[j] < ob[i]]
        score[i] = equal[i] + max([0.0, *before])
    return max(score.values())


def test_fenwick_chains_are_the_best():
    import numpy as np

    rng = np.random.default_rng(4)
    for _ in range(60):
        n = rng.integers(1, 30)
        begin, ob, size = rng.integers(0, 200, n), rng.integers(0, 200, n), rng.integers(5, 20, n)
        parts = (begin, begin + size, ob, ob + size, size)
        found = chains(*parts)
        assert sorted(i for c in found for i in c) == list(range(n))
        first = found[0]
        assert all(begin[a] < begin[b] and ob[a] < ob[b] for a, b in zip(first, first[1:]))
        own = sum(size[i] for i in first) - chaining.GAP_COST * sum(
            (begin[b] - parts[1][a]) + (ob[b] - parts[3][a]) for a, b in zip(first, first[1:]))
        assert abs(own - best_chain(parts)) < 1e-6


def test_licenses_are_found_with_their_differences(spark):
    prose = "Thing of other words stands here. A license to thrill is no notice at all, nor is a copyright."
    rows = [(1, f"{prose}\nReleased under the MIT License.\nMore."), (2, TEMPLATES["Apache-2.0 (notice)"]), (3, prose),
            (4, "x " * 3000 + "\n" + TEMPLATES["GPL-3.0"].replace("version 3", "version 2")), (5, None), (6, ""),
            (7, "RELEASED   UNDER the\tMIT   license"), (8, "\n".join([TEMPLATES["MIT"], TEMPLATES["CC-BY-NC-4.0"]])),
            (None, TEMPLATES["MPL-2.0"]), (1, "Released under the MIT License."), (9, "licence" * 4000)]
    got = license_findings(awkward(documents(spark, rows))).collect()
    texts = {i: t for i, t in rows}
    found = sorted(((r.doc_id, r.license, r.verdict) for r in got), key=repr)
    assert found == sorted([(1, "MIT", "exact"), (1, "MIT", "exact"), (2, "Apache-2.0 (notice)", "exact"),
                            (4, "GPL-3.0", "modified"), (7, "MIT", "exact"), (8, "MIT", "exact"), (8, "CC-BY-NC-4.0", "exact"),
                            (None, "MPL-2.0", "exact")], key=repr)
    for r in got:
        if r.doc_id not in (1,):
            assert texts[r.doc_id][r.begin:r.begin + r.length] == r.wording
    changed = next(r for r in got if r.doc_id == 4)
    assert (changed.missing, changed.added) == (["3"], ["2"])
    assert license_findings(documents(spark, [])).count() == 0


def test_the_right_template_saves_most():
    scanner = Scanner(TEMPLATES)
    for name, text in TEMPLATES.items():
        saved, first = scanner.ranked(scanner.normal(text))[0]
        assert first == name and saved > 0.5
        assert scanner.findings(text)[0][2] == name


def test_long_sentences_are_cut_not_dropped():
    text = "word " * 5000 + TEMPLATES["BSD (redistribution)"]
    assert any("redistribution and use" in b.lower() for _, b in candidate_blocks(text))


def test_parts_of_a_chain_are_passages(spark):
    """A shared passage next to a shorter or equal one behind 30 or 35 other words is reported by itself."""
    rng = random.Random(12)
    p, q, r = (rng.choices(WORDS, k=k) for k in (60, 20, 60))
    for second, gap, want in ((q, 30, 1), (r, 35, 2)):
        rows = []
        for i in range(2):
            other = [f"o{i}x{k}" for k in range(gap)]
            rows.append((i, " ".join([f"b{i}", *p, *other, *second, f"e{i}"])))
        got = repeated_passages(documents(spark, rows)).collect()
        assert len(got) == want and all(x.words == x.equal == 60 for x in got)
        assert {x.begin for x in got} == ({1} if want == 1 else {1, 61 + gap})


def test_wrapped_and_commented_notices_are_found(spark):
    names = ["MIT (permission)", "BSD (redistribution)", "GPL-3.0 (notice)", "Apache-2.0 (notice)", "MPL-2.0"]
    prose, rows, want = "Some thing of other words stands here, and more of it.", [], []
    for name in names:
        for width in (40, 72):
            for mark in ("", " * ", "# ", "// "):
                lines = textwrap.wrap(TEMPLATES[name], width, break_on_hyphens=False, break_long_words=False)
                want.append((len(rows), name, "exact"))
                rows.append((len(rows), "\n".join([prose, "", *(mark + x for x in lines), "", prose])))
    both = [*textwrap.wrap(TEMPLATES["MIT (permission)"], 60), "", *textwrap.wrap(TEMPLATES["BSD (redistribution)"], 60)]
    want += [(len(rows), names[0], "exact"), (len(rows), names[1], "exact")]
    rows.append((len(rows), "\n".join(both)))
    got = license_findings(documents(spark, rows)).collect()
    assert sorted((r.doc_id, r.license, r.verdict) for r in got) == sorted(want)
    for r in got:
        assert rows[r.doc_id][1][r.begin:r.begin + r.length] == r.wording


def test_all_texts_that_share_a_passage_or_a_fragment_meet(spark, monkeypatch):
    """Also those that share a fragment alone, whose seeds other texts held before, and each two of many holders."""
    rng = random.Random(21)
    pool = lambda i: [f"t{i}x{k}" for k in range(40)]
    for block in (3_000_000, 60):
        monkeypatch.setattr(chaining, "BLOCK_SEEDS", block)
        p = rng.choices(WORDS, k=180)
        spans = [(0, 180), (0, 70), (50, 120), (55, 125), (100, 180), (0, 180), (110, 180)]
        rows = [(i, " ".join([*pool(i), *p[a:b], *pool(i + 50)])) for i, (a, b) in enumerate(spans)]
        want = {(i, j) for i, (a, b) in enumerate(spans) for j, (c, d) in enumerate(spans) if i > j and min(b, d) - max(a, c) >= 50}
        for order in (rows, rows[::-1]):
            got = repeated_passages(documents(spark, order, 4)).collect()
            assert {(r.doc_id, r.other_id) for r in got} == want
            for r in got:
                (a, b), (c, d) = spans[r.doc_id], spans[r.other_id]
                assert r.words == r.equal == min(b, d) - max(a, c)
    # Copies meet all texts that their words meet, and each other.
    copied = [*rows, (7, rows[1][1].upper()), (8, rows[1][1])]
    same = {1: 1, 7: 1, 8: 1}
    got = repeated_passages(documents(spark, copied)).collect()
    pairs = {(i, j) for i in range(9) for j in range(i) if (max(same.get(i, i), same.get(j, j)), min(same.get(i, i), same.get(j, j))) in want}
    assert {(r.doc_id, r.other_id) for r in got} == pairs | {(7, 1), (8, 1), (8, 7)}
    # A line that repeats often, and a passage behind it in one of the texts.
    line, q = rng.choices(WORDS, k=12), rng.choices(WORDS, k=60)
    rows = [(1, " ".join([*line * 12, *pool(1), *q])), (2, " ".join([*q, *pool(2), *line * 30])), (3, " ".join([*pool(3), *q]))]
    got = repeated_passages(documents(spark, rows)).collect()
    assert {(r.doc_id, r.other_id, r.words) for r in got if r.begin >= 40 or r.doc_id == 3} >= {(3, 1, 60), (3, 2, 60)}
    assert {(2, 1)} <= {(r.doc_id, r.other_id) for r in got if r.words == 144}
    assert {(2, 1)} <= {(r.doc_id, r.other_id) for r in got if r.words == 60}


def test_matches_hold_whatever_the_sign_of_a_hash():
    import numpy as np

    rng = np.random.default_rng(5)
    seed = rng.integers(-2**63, 2**63 - 1, 200)
    side = lambda row: chaining._side(np.concatenate([seed, seed[:3].repeat(12)]), np.full(236, row), np.arange(236))
    one, other = side(1), side(2)
    i, j = chaining.matches_of(*[(s[0], s[4], s[5]) for s in (one, other)])
    got = set(zip(one[2][i].tolist(), other[2][j].tolist()))
    assert got == {(k, k) for k in range(236)} and len(i) == len(got)
