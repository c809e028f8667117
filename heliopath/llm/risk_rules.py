"""Quality rules whose cutoffs limit false rejection, per stratum, with a proof.

Signals of a text become a few badness measures. Labelled rows are split by
id. The good rows of one third give, per stratum, ever sharper cutoffs: the upper
quantiles of each measure at the levels ``TAILS``. The others test them from mild
to sharp: a level is accepted while the exact binomial test says, at
confidence 1 - delta / strata (Bonferroni over the strata; levels of a stratum
are tested in fixed order, which costs nothing), that no more than ``alpha``
of the good rows would be rejected. The last accepted level counts. A stratum
with too few labels for any proof rejects nothing beyond the fixed rules.

A null or empty text has no words and fails the fixed rules. A null stratum is
one of its own. Labels of ids that do not occur are ignored; an id with
several labels is good only if all are. Repeated rows each get their verdict.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import Index, parts_of, stored, texts_of

WINDOW = 5
TAILS = (0.0005, 0.001, 0.002, 0.003, 0.005, 0.008)
SIGNALS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_marks")
BLANK = b" \t\n\v\f\r"


def repeated_words(words: list[bytes]) -> int:
    """Words inside windows that occur twice or more; windows are compared exactly."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    one = Index().numbers(words)
    k = int(one.max()) + 1
    two = one[:-1] * k + one[1:]
    two = np.unique(two, return_inverse=True)[1]
    four = two[:-2] * (int(two.max()) + 1) + two[2:]
    four = np.unique(four, return_inverse=True)[1]
    _, kind, times = np.unique(four[:n] * k + one[4:4 + n], return_inverse=True, return_counts=True)
    again = times[kind] > 1
    if not again.any():
        return 0
    step = np.zeros(len(words) + 1, np.int64)
    step[:n] += again
    step[WINDOW:WINDOW + n] -= again
    return int((np.cumsum(step) > 0).sum())


def signals_of(data: bytes) -> tuple[int, ...]:
    words = data.split()
    inside = data.translate(None, BLANK)
    lines = [line for line in data.split(b"\n") if line.strip(BLANK)]
    without = lambda marks: len(inside) - len(inside.translate(None, marks))
    return (len(words), len(inside.decode()), without(b"#*$%&|<>"), len(lines) - len(set(lines)), repeated_words(words),
            len(lines), without(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), without(b"0123456789"), without(b"!?=@\\^~_{}[]"))


def signals(docs: DataFrame, stratum_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, stratum, the signals, base_failed) of every row."""
    import pyarrow as pa

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
                       F.col(stratum_col).cast("string").alias("stratum"))

    def measure(batches):
        for batch in batches:
            for part in parts_of(batch):
                found = np.array([signals_of(d) for d in texts_of(part.column(1))], np.int64).reshape(-1, len(SIGNALS))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), *[pa.array(c) for c in found.T.copy()]], ["doc_id", "stratum", *SIGNALS])

    schema = "doc_id long, stratum string, " + ", ".join(f"{s} long" for s in SIGNALS)
    return rows.mapInArrow(measure, schema).withColumn(
        "base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def measures() -> dict[str, Column]:
    """Higher is worse."""
    per = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return {"symbols": per("n_symbols", "word_chars"), "repeated_lines": per("n_dup_lines", "n_lines"),
            "repeated_words": per("n_repeat_words", "n_words"), "capitals": per("n_upper", "word_chars"),
            "digits": per("n_digits", "word_chars"), "marks": per("n_marks", "n_words"),
            "long_words": per("word_chars", "n_words")}


def at_most_chance(failures: int, trials: int, rate: float) -> float:
    """P(X <= failures) for X binomial(trials, rate), summed exactly."""
    if failures >= trials:
        return 1.0
    log = lambda k: (math.lgamma(trials + 1) - math.lgamma(k + 1) - math.lgamma(trials - k + 1)
                     + k * math.log(rate) + (trials - k) * math.log1p(-rate))
    return min(1.0, math.fsum(math.exp(log(k)) for k in range(failures + 1)))


def accepted_level(failures: list[int], trials: int, alpha: float, delta: float) -> int:
    """Number of levels, from the mildest, whose false rejection is proven to be at most alpha."""
    for level, k in enumerate(failures):
        if k > alpha * trials or at_most_chance(k, trials, alpha) > delta:
            return level
    return len(failures)


def cutoffs(measured: DataFrame, labels: DataFrame, alpha: float = 0.02, delta: float = 0.05,
            id_col: str = "doc_id", good_col: str = "quality") -> DataFrame:
    """(stratum, level, trials, failures, one cutoff per measure), one row per stratum with labelled good rows.

    ``measured`` has doc_id, stratum, base_failed and signals. Cutoffs are null where no level is proven.
    """
    good = (labels.groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.min(good_col).alias("good"))
            .filter("good = 1").select("doc_id"))
    names = measures()
    rows = (measured.filter(~F.col("base_failed")).join(good, "doc_id").select(
        F.coalesce("stratum", F.lit("")).alias("stratum"), F.col("stratum").isNull().alias("no_stratum"),
        (F.crc32(F.col("doc_id").cast("string")) % 3 == 0).alias("fitting"), *[m.alias(n) for n, m in names.items()]))
    quantiles = [F.percentile_approx(n, [1 - t for t in TAILS], 20_000).alias(f"{n}_cuts") for n in names]
    key = ["stratum", "no_stratum"]
    # One row per stratum, written: its size is known when the join with the much larger and skewed rows is planned.
    fitted = stored(rows.filter("fitting").groupBy(*key).agg(*quantiles))
    over = lambda level: F.greatest(*[(F.col(n) > F.col(f"{n}_cuts")[level]).cast("long") for n in names])
    tested = (rows.filter(~F.col("fitting")).join(fitted, key).groupBy(*key)
              .agg(F.count("*").alias("trials"), F.array(*[F.sum(over(i)) for i in range(len(TAILS))]).alias("failures"),
                   *[F.first(f"{n}_cuts").alias(f"{n}_cuts") for n in names]))
    tested = stored(tested)
    strata = max(1, tested.count())
    level = F.udf(lambda failures, trials: accepted_level(failures, trials, alpha, delta / strata), "int")
    return (tested.withColumn("level", level("failures", "trials"))
            .select(F.when(~F.col("no_stratum"), F.col("stratum")).alias("stratum"), "level", "trials", "failures",
                    *[F.when(F.col("level") > 0, F.element_at(f"{n}_cuts", F.greatest("level", F.lit(1)))).alias(f"{n}_cut")
                      for n in names]))


def judge(docs: DataFrame, labels: DataFrame, stratum_col: str = "lang", alpha: float = 0.02, delta: float = 0.05,
          id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, stratum, signals, base_failed, kept) of every row."""
    measured = stored(signals(docs, stratum_col, id_col, text_col))
    # A few rows, written: the planner sees their size and decides how to join.
    cuts = stored(cutoffs(measured, labels, alpha, delta, id_col).drop("failures", "trials", "level"))
    cuts = cuts.withColumnRenamed("stratum", "cut_stratum")
    exceeded = F.greatest(*[F.coalesce(m > F.col(f"{n}_cut"), F.lit(False)) for n, m in measures().items()])
    return (measured.join(cuts, F.col("stratum").eqNullSafe(F.col("cut_stratum")), "left")
            .withColumn("kept", ~F.col("base_failed") & ~exceeded)
            .select("doc_id", "stratum", *SIGNALS, "base_failed", "kept"))
