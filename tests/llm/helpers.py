"""Small tables with the awkward cases, and plain-Python forms of the rules."""

from pyspark.sql import types as T

DOCUMENTS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType())])


def documents(spark, rows, parts=3):
    """rows: (doc_id, text) or (doc_id, text, lang, source)."""
    whole = [(*r, *(None,) * (4 - len(r)), len(r[1] or "")) for r in rows]
    return spark.createDataFrame(whole, DOCUMENTS).repartition(parts)


def awkward(df):
    """The table with further columns under names that operators use inside."""
    from pyspark.sql import functions as F

    return df.withColumns({"fp": F.lit("x"), "row": F.lit(1), "size": F.lit("y"), "key": F.lit(0), "words": F.lit("z"),
                           "part": F.lit(3), "n_tokens": F.lit(None).cast("string"), "block": F.lit(True),
                           "_row": F.lit(77), "log_weight": F.lit("w"), "n_features": F.lit(1), "word_weight": F.lit(2), "own": F.lit(0),
                           "mark": F.lit("m"), "tag": F.lit(1), "first": F.lit(2), "selected": F.lit("s")})


def words(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", text or "")
