"""Look-ups with life times against a plain loop over each key's requests."""

import random

from pyspark.sql import functions as F

from heliopath.operators.lookups import timed_lookups

SCHEMA = "cell string, fix_ms long, fix_id long, life long"


def plain(rows):
    held, out = {}, []
    for cell, at, one, life in sorted(r for r in set(rows) if None not in r):
        until, by = held.get(cell, (at, None))
        asks = until <= at
        if asks:
            held[cell] = at + life, one
        out.append((cell, at, one, asks, one if asks else by))
    return out


def got(spark, rows):
    found = timed_lookups(spark.createDataFrame(rows, SCHEMA), F.col("life")).collect()
    return sorted(tuple(r) for r in found)


def test_requests_ask_when_the_answer_has_run_out(spark):
    rng = random.Random(4)
    rows, at = [], 0
    for i in range(1500):
        at += rng.choice([0, 1, 900, 14_000, 30_000, 400_000, 90_000_000 if rng.random() < .02 else 5])
        # Half of the requests are of one cell.
        rows.append(("hot" if rng.random() < .5 else f"c{rng.randrange(9)}", at, i, rng.choice([30_000, 900_000, 600_000])))
    assert got(spark, rows) == plain(rows)


def test_borders_of_life_and_ties(spark):
    rows = [("a", 1000, 2, 30_000), ("a", 1000, 1, 30_000), ("a", 30_999, 3, 30_000), ("a", 31_000, 5, 900_000),
            ("a", 31_000, 4, 30_000), ("a", 60_999, 6, 30_000), ("a", 61_000, 7, 30_000), ("b", -5, 8, 30_000)]
    assert got(spark, rows) == plain(rows)
    assert [r[2] for r in got(spark, rows) if r[3]] == [1, 4, 7, 8]


def test_a_chain_of_failures(spark):
    rows = [("a", 30_000 * i, i, 30_000) for i in range(200)]
    assert all(r[3] for r in got(spark, rows))


def test_repeated_null_and_no_rows(spark):
    rows = [("a", 5, 1, 30_000)] * 3 + [(None, 5, 2, 30_000), ("a", None, 3, 30_000), ("a", 5, None, 30_000)]
    assert got(spark, rows) == [("a", 5, 1, True, 1)]
    assert got(spark, []) == []
