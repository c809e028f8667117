"""The document pipeline: stages over ``documents``, each written and read again.

Every stage takes all rows its predecessor kept and returns the columns of
``documents`` unchanged, but for the last, which returns one row per document
of the token files it has written: doc_id, start, n_tokens and ids_crc32 as
read back from them. A null id is an id of its own; repeated rows stay until
near-dedup, which keeps one document of a group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliopath.llm.mixing import mixed
from heliopath.llm.near_copies import without_near_copies
from heliopath.llm.queries import vocabulary
from heliopath.llm.resampling import resample
from heliopath.llm.spaced_seeds import without_leaks
from heliopath.llm.tables import stored, table, work_dir
from heliopath.llm.token_files import SMALL_STORE, read_digests, write_sequences

END_ID = 2
ORACLE_SQL = None  # token ids and model weights are beyond SQL; tests hold the stages against plain Python


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that importance resampling does not draw."""
    drawn = resample(docs, table(spark, sf_dir, "labels"), docs.columns)
    return drawn.filter("selected").select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a five-word Jaccard similarity of 0.8 and more: the one with the least id."""
    return without_near_copies(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents in which a benchmark item leaks."""
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows repeated as the mix takes them; the last row of a source's budget holds the words that fit."""
    return mixed(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Arrow sequence files in the shared folder, and their documents as read back."""
    root = f"{work_dir(spark)}/sequences"
    parts = write_sequences(docs, root, vocabulary("byte_bpe_50k.json"), END_ID, store=SMALL_STORE)
    return read_digests(spark, parts, root)


STAGES = [
    ("quality classifier", keep_quality),
    ("SimHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("mixing sources", mix_sources),
    ("token-ID output", write_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        rows = stored(stage(spark, rows, sf_dir))
    return STAGES[-1][1](spark, rows, sf_dir)
