"""One registered query per operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import table, work_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), limit=2048)


@query
def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_files import read_digests, write_sequences

    root = f"{work_dir(spark)}/sequences"
    docs = table(spark, sf_dir, "documents")
    parts = write_sequences(docs, root, vocabulary("byte_bpe_50k.json"), end_id=2)
    return read_digests(spark, parts, root)


@query
def op9_covering_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .covering import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"))
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return found.select("doc_id", hexed.alias("fingerprint"), "component_id")


@query
def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    mixed = mix(table(spark, sf_dir, "documents"), ["doc_id"])
    return mixed.select("row.doc_id", "size", "source_size", "target", "taken")


ORACLES["op6_source_mix"] = r"""
WITH d AS (
  SELECT doc_id, source IS NULL AS missing, coalesce(source, '') AS name, md5(doc_id::VARCHAR) AS key,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents),
s AS (
  SELECT missing, name, sum(size)::BIGINT AS source_size, 1 + (row_number() OVER (ORDER BY missing, name) - 1) % 3 AS weight
  FROM d GROUP BY missing, name),
o AS (
  SELECT *, row_number() OVER (ORDER BY source_size / weight, missing, name) AS place FROM s),
l AS (
  SELECT a.*, (SELECT sum(source_size) FROM o)::DOUBLE
              - coalesce((SELECT sum(3 * source_size) FROM o b WHERE b.place < a.place), 0)::DOUBLE AS rest,
         (SELECT sum(weight) FROM o b WHERE b.place >= a.place)::DOUBLE AS weight_left
  FROM o a),
v AS (SELECT rest / weight_left AS level FROM l WHERE 3 * source_size / weight > rest / weight_left ORDER BY place LIMIT 1),
t AS (
  SELECT missing, name, source_size,
         coalesce(least((3 * source_size)::DOUBLE, weight * (SELECT level FROM v)), 0.0) AS target FROM l),
r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, floor(t.target)::BIGINT AS budget,
         coalesce(sum(d.size) OVER (PARTITION BY d.missing, d.name ORDER BY d.key
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM d JOIN t USING (missing, name))
SELECT doc_id, size, source_size, target,
       (CASE WHEN source_size = 0 THEN 0 ELSE
          (budget // source_size) * size + greatest(0, least(size, budget % source_size - before)) END)::BIGINT AS taken
FROM r
"""


@query
def op5_risk_controlled_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .risk_rules import judge

    judged = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                         "kept", "stratum")


@query
def op7_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .resampling import resample

    drawn = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"])
    return drawn.select("row.doc_id", "n_features", "log_weight", "word_weight", "draw_key", "selected")


@query
def op4_spaced_seed_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spaced_seeds import leaks

    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op1_context_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .context_trees import score_texts

    return score_texts(table(spark, sf_dir, "documents"))


@query
def op2_license_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import license_findings

    found = license_findings(table(spark, sf_dir, "documents"))
    return found.withColumns({"missing": F.array_join("missing", " "), "added": F.array_join("added", " ")})


@query
def op3_chained_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chaining import repeated_passages

    return repeated_passages(table(spark, sf_dir, "documents"))


@query
def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fill_middle import fill_in_middle, restored

    cut = fill_in_middle(table(spark, sf_dir, "documents"), ["doc_id"])
    back = restored(F.col("output"), F.col("form"))
    return cut.select("row.doc_id", F.col("n_units").alias("n"), "form", "prefix_chars", "middle_chars",
                      F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


ORACLES["op11_fill_in_middle"] = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents),
h AS (
  SELECT doc_id, t, length(t) AS n, ('0x' || substr(x, 1, 8))::BIGINT AS h1, ('0x' || substr(x, 9, 8))::BIGINT AS h2,
         ('0x' || substr(x, 17, 8))::BIGINT AS h3, ('0x' || substr(x, 25, 8))::BIGINT AS h4 FROM d),
c AS (
  SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, substr(t, 1, a) AS pre, substr(t, a + 1, b - a) AS mid, substr(t, b + 1) AS suf FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN a::BIGINT END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN (b - a)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
              ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""


@query
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .merkle import manifest, text_of

    drawn = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7 == 0
    tampered = {"n_chars": F.when(drawn, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}
    made = manifest(table(spark, sf_dir, "documents"), ["doc_id", "source", "lang", "n_chars", "text"], "lang", "doc_id", tampered)
    hexed = {name: text_of(F.col(name)) for name in ("leaf", "subroot", "root")}
    return made.select(F.col("id").alias("doc_id"), *[c.alias(n) for n, c in hexed.items()],
                       F.sha2(text_of(F.col("proof")), 256).alias("proof_sha256"), text_of(F.col("folded")).alias("folded_root"),
                       "verified")


ORACLES["op13_merkle_manifest"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, lang, n_chars, coalesce(doc_id::VARCHAR, '') AS digits,
         coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
         || coalesce(strlen(lang) || ':' || lang, '-') AS head, coalesce(strlen(text) || ':' || text, '-') AS tail
  FROM documents),
c AS (
  SELECT *, coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS own,
         coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') AS other,
         xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, length(digits) + 1),
               lambda i: list_prepend(ascii(digits[i])::BIGINT, [-1::BIGINT, -1, -1, -1, -1, -1, -1, -1])))),
             lambda a, o: CASE WHEN o >= 0 THEN xor(a, o) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295) AS crc
  FROM d),
h AS (
  SELECT doc_id, lang, sha256(head || own || tail) AS leaf,
         sha256(head || CASE WHEN crc % 7 = 0 THEN other ELSE own END || tail) AS start FROM c),
l AS (
  SELECT doc_id, leaf, start, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM h),
n AS (
  SELECT tree, 0 AS lev, idx, leaf AS hash, count(*) OVER (PARTITION BY tree) AS size FROM l
  UNION ALL
  SELECT tree, lev + 1, idx // 2, sha256(string_agg(hash, '' ORDER BY idx)), (any_value(size) + 1) // 2
  FROM n WHERE size > 1 GROUP BY tree, lev, idx // 2),
s AS (SELECT tree, lev, hash AS subroot FROM n WHERE size = 1),
m AS (
  SELECT 0 AS lev, tree AS idx, subroot AS hash, count(*) OVER () AS size FROM s
  UNION ALL
  SELECT lev + 1, idx // 2, sha256(string_agg(hash, '' ORDER BY idx)), (any_value(size) + 1) // 2
  FROM m WHERE size > 1 GROUP BY lev, idx // 2),
climb AS (
  SELECT doc_id, leaf, tree, idx AS place, 0 AS lev, start AS folded, '' AS proof, false AS top FROM l
  UNION ALL
  SELECT c.doc_id, c.leaf, c.tree, CASE WHEN o.hash IS NULL THEN c.tree ELSE c.place // 2 END,
         CASE WHEN o.hash IS NULL THEN 0 ELSE c.lev + 1 END,
         CASE WHEN o.hash IS NULL THEN c.folded WHEN c.place % 2 = 0 THEN sha256(c.folded || coalesce(b.hash, ''))
              ELSE sha256(b.hash || c.folded) END,
         c.proof || CASE WHEN o.hash IS NULL THEN '' ELSE coalesce(b.hash, '') END, o.hash IS NULL
  FROM climb c LEFT JOIN n o ON o.tree = c.tree AND o.lev = c.lev AND o.idx = c.place AND o.size > 1
       LEFT JOIN n b ON b.tree = c.tree AND b.lev = c.lev AND b.idx = xor(c.place, 1)
  WHERE NOT c.top),
up AS (
  SELECT doc_id, leaf, tree, place, lev, folded, proof FROM climb WHERE top
  UNION ALL
  SELECT c.doc_id, c.leaf, c.tree, c.place // 2, c.lev + 1,
         CASE WHEN c.place % 2 = 0 THEN sha256(c.folded || coalesce(b.hash, '')) ELSE sha256(b.hash || c.folded) END,
         c.proof || coalesce(b.hash, '')
  FROM up c JOIN m o ON o.lev = c.lev AND o.idx = c.place AND o.size > 1
       LEFT JOIN m b ON b.lev = c.lev AND b.idx = xor(c.place, 1))
SELECT doc_id, leaf, subroot, r.hash AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = r.hash AS verified
FROM up JOIN s USING (tree) JOIN m r ON r.size = 1 AND r.lev = up.lev
"""


@query
def op12_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repeats import cut_texts, text_key

    docs = table(spark, sf_dir, "documents")
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s.end - s.begin)
    told = cut_texts(docs).select("key", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
                                  F.sha2("kept", 256).alias("kept_sha256"))
    return docs.select("doc_id", text_key().alias("key")).join(told, "key").drop("key")


ORACLES["op12_repeated_bytes"] = r"""
WITH d AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS x, strlen(coalesce(text, '')) AS n FROM documents),
o AS (SELECT doc_id, x, n, unnest(range((n - 200) // 1000 + 1)) AS o FROM d WHERE n >= 200),
b AS (SELECT doc_id, o, substr(x, 2000 * o + 1, 2398) AS part, least(1000, n - 199 - 1000 * o) AS m FROM o),
w AS (SELECT doc_id, 1000 * o + j AS i, md5_number(substr(part, 2 * j + 1, 400)) AS win
      FROM (SELECT doc_id, o, part, unnest(range(m)) AS j FROM b)),
r AS (SELECT doc_id, i FROM w JOIN (SELECT win FROM w GROUP BY win HAVING count(*) > 1) USING (win)),
g AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM r),
k AS (SELECT doc_id, i, count(*) FILTER (WHERE p IS NULL OR i > p + 200) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g),
s AS (SELECT doc_id, run, min(i) AS b, max(i) + 200 AS e FROM k GROUP BY doc_id, run),
c AS (SELECT doc_id, run, b, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY b), 0) AS from_ FROM s),
a AS (SELECT doc_id, count(*) AS n_spans, sum(e - b) AS n_removed, max(e) AS last,
      string_agg(substr(x, 2 * from_ + 1, 2 * (b - from_)), '' ORDER BY b) AS head FROM c JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(head, '') || substr(x, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN a USING (doc_id)
"""
