import random
import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from heliopath.llm import merkle
from heliopath.llm.queries import QUERIES

from .helpers import awkward, documents

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def climb(levels, at):
    """Siblings of the node at place ``at`` of the lowest level: (left, right) texts, level by level."""
    out = []
    for level in levels[:-1]:
        run = level[at // 2 * 2:at // 2 * 2 + 2]
        out.append(("".join(run[:at % 2]), "".join(run[at % 2 + 1:])))
        at //= 2
    return out


def tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([h(*last[i:i + 2]) for i in range(0, len(last), 2)])
    return levels


def plain_manifest(rows):
    """Sorted result rows of the rule, for rows with the fields in order."""
    made, groups = [], {}
    for r in rows:
        drawn = zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 7 == 0
        other = [*r[:3], r[3] + 1 if drawn and r[3] is not None else r[3], r[4]]
        groups.setdefault(r[2], []).append((r[0], h(*map(field, r)), h(*map(field, other))))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[g] = tree([x[1] for x in groups[g]])
    top = tree([trees[g][-1][0] for g in order])
    for k, g in enumerate(order):
        for i, (d, leaf, start) in enumerate(groups[g]):
            path = climb(trees[g], i) + climb(top, k)
            folded = start
            for left, right in path:
                folded = h(left, folded, right)
            made.append((d, leaf, trees[g][-1][0], top[-1][0], h("".join(a + b for a, b in path)), folded, folded == top[-1][0]))
    return sorted(made, key=repr)


def shape(df):
    hexed = [merkle.text_of(F.col(c)) for c in ("leaf", "subroot", "root")]
    return sorted(map(tuple, df.select("id", *hexed, F.sha2(merkle.text_of(F.col("proof")), 256), merkle.text_of(F.col("folded")),
                                       "verified").collect()), key=repr)


def corpus(n):
    rng = random.Random(n)
    rows = [(i if rng.random() < 0.95 else None, rng.choice(["", "wörds here", None, "x" * 50_000]), rng.choice(["a", "é", None, "b b"]),
             rng.choice([None, "s", ""])) for i in range(n)]
    return rows + rows[:3]  # repeated rows


@pytest.mark.parametrize("stride, n", [(10, 200), (2, 90), (1, 6), (2, 1)])
def test_agrees_with_plain_rule(spark, stride, n, monkeypatch):
    monkeypatch.setattr(merkle, "STRIDE", stride)
    docs = documents(spark, corpus(n)).withColumn("n_chars", F.when(F.col("n_chars") > 0, F.col("n_chars")))
    drawn = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7 == 0
    got = merkle.manifest(awkward(docs), FIELDS, "lang", "doc_id",
                          {"n_chars": F.when(drawn, F.col("n_chars") + 1).otherwise(F.col("n_chars"))})
    assert shape(got) == plain_manifest([tuple(r) for r in docs.select(*FIELDS).collect()])


def test_one_group_holds_most_rows(spark, monkeypatch):
    monkeypatch.setattr(merkle, "STRIDE", 4)
    docs = documents(spark, [(i, f"t{i}", "en" if i % 9 else "fr", "s") for i in range(400)], parts=6)
    got = merkle.manifest(docs, FIELDS, "lang", "doc_id", {})
    assert all(r.verified for r in got.collect()) and got.count() == 400


def test_empty_table(spark):
    assert merkle.manifest(documents(spark, []), FIELDS, "lang", "doc_id", {}).count() == 0


def test_query_tells_tampered_rows(spark):
    got = QUERIES["op13_merkle_manifest"](spark, "/root/testdata/sf0.001").collect()
    assert len(got) == 200
    assert all(r.verified == (zlib.crc32(str(r.doc_id).encode()) % 7 != 0) for r in got)
