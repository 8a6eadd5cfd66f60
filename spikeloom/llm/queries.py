"""The registered queries of this subpackage, their SQL twins, and the corpus pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spikeloom.llm import bpe, decontaminate, exact, jaccard, langid, neighbors, periods, pii, quality, sharding, suffixes, toxicity, trie


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _ranks() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_join(_read(spark, sf_dir, "documents"), 4, 85).select("doc_id", "n_shingles", "component_id", "n_links")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_id(_read(spark, sf_dir, "documents"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.byte_bpe(_read(spark, sf_dir, "documents"), *_ranks())


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_by_size(_read(spark, sf_dir, "documents"), 16)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace_pii(_read(spark, sf_dir, "documents")).select("doc_id", F.col("new_text").alias("text"), "n_entities", F.array_join(F.col("entities.kind"), ",").alias("kinds"))


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbors.near_duplicates(_read(spark, sf_dir, "embeddings"), 0.98)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(_read(spark, sf_dir, "documents"), 50)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.decontaminate(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), 10)
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(names.cast("binary"), 256).alias("items_sha256"), "contaminated")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(_read(spark, sf_dir, "conversations"), mixed=True)


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(_read(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.periodic_runs(_read(spark, sf_dir, "documents"), rewrite=True)


_ABC = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

OP1_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_ABC}), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct([array_to_string(ws[i:i + 3], ' ') FOR i IN range(1, len(ws) - 2)]) END AS sh FROM w),
p AS MATERIALIZED (SELECT doc_id, unnest(sh) AS x FROM s),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM p a JOIN p b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (
  SELECT a, b FROM pairs JOIN s sa ON sa.doc_id = a JOIN s sb ON sb.doc_id = b
  WHERE 100 * i >= 85 * (len(sa.sh) + len(sb.sh) - i)),
e AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, node) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, e.b FROM reach JOIN e ON e.a = reach.node),
c AS (SELECT doc_id, min(node) AS component_id FROM reach GROUP BY doc_id),
l AS (SELECT a AS doc_id, count(*) AS n_links FROM e GROUP BY a)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, component_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links FROM s JOIN c USING (doc_id) LEFT JOIN l USING (doc_id)
"""

OP8_SQL = """
WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents),
g AS MATERIALIZED (SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS x FROM (SELECT doc_id, h, unnest(range(n - 49)) AS p FROM d WHERE n >= 50)),
f AS MATERIALIZED (SELECT x, min(doc_id) AS least FROM g GROUP BY x),
hit AS (SELECT doc_id, p, coalesce(p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) > 50, true) AS fresh FROM g JOIN f USING (x) WHERE least < doc_id),
run AS (SELECT doc_id, p, sum(fresh::INTEGER) OVER (PARTITION BY doc_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS k FROM hit),
gone AS MATERIALIZED (SELECT doc_id, min(p) AS a, max(p) + 50 AS b FROM run GROUP BY doc_id, k),
keep AS (
  SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS a, a AS b FROM gone
  UNION ALL SELECT doc_id, coalesce(max(gone.b), 0), any_value(n) FROM d LEFT JOIN gone USING (doc_id) GROUP BY doc_id),
rest AS (SELECT doc_id, string_agg(substr(h, 2 * a + 1, 2 * (b - a)), '' ORDER BY a) AS r FROM keep JOIN d USING (doc_id) GROUP BY doc_id),
sums AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM gone GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(r)) AS kept_sha256
FROM d JOIN rest USING (doc_id) LEFT JOIN sums USING (doc_id)
"""

OP9_SQL = rf"""
WITH b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {_ABC}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
win AS MATERIALIZED (
  SELECT DISTINCT item_id, n, unnest([array_to_string(ws[i:i + n - 1], ' ') FOR i IN range(1, len(ws) - n + 2)]) AS x
  FROM (SELECT item_id, ws, least(10, len(ws)) AS n FROM b) WHERE n > 0),
d AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_ABC}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
sizes AS (SELECT DISTINCT n FROM win),
runs AS (
  SELECT doc_id, n, unnest(range(1, len(ws) - n + 2)) AS i, unnest([array_to_string(ws[i:i + n - 1], ' ') FOR i IN range(1, len(ws) - n + 2)]) AS x
  FROM d, sizes WHERE len(ws) >= n),
hits AS MATERIALIZED (SELECT doc_id, i, runs.n, item_id FROM runs JOIN win ON runs.x = win.x AND runs.n = win.n),
words AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP11_SQL = r"""
WITH RECURSIVE t AS MATERIALIZED (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS k
  FROM conversations WHERE conv_id IS NOT NULL),
crc AS (SELECT i, list_reduce(list_prepend(i, range(8)), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(3988292384, x // 2) ELSE x // 2 END) AS v FROM range(256) r(i)),
ids AS MATERIALIZED (SELECT DISTINCT c, CAST(c AS VARCHAR) AS s FROM t),
step(c, s, k, v) AS (
  SELECT c, s, 0, 4294967295::BIGINT FROM ids
  UNION ALL SELECT c, s, k + 1, xor(step.v // 256, crc.v) FROM step JOIN crc ON crc.i = xor(step.v % 256, ascii(substr(s, k + 1, 1))) WHERE k < length(s)),
h AS MATERIALIZED (SELECT c, xor(v, 4294967295::BIGINT) % 4 AS h FROM step WHERE k = length(s)),
r AS MATERIALIZED (
  SELECT c, row_number() OVER (PARTITION BY c ORDER BY own, k) AS d, role, text FROM (
    SELECT h.c, 0 AS own, k, role, text FROM h JOIN t ON t.c = h.c - h.c % 20 AND k < h
    UNION ALL SELECT h.c, 1, k, role, text FROM h JOIN t ON t.c = h.c AND k >= h)),
p AS MATERIALIZED (
  SELECT c, d, text, array_agg(struct_pack(r := role, t := text)) OVER (PARTITION BY c ORDER BY d) AS seq FROM r
  UNION ALL SELECT c, 0, '', [] FROM ids),
n AS MATERIALIZED (SELECT row_number() OVER () AS id, * FROM (SELECT seq, min(d) AS d, min(c) AS c, count(*) AS m, any_value(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))) AS w FROM p GROUP BY seq)),
q AS MATERIALIZED (SELECT p.c, p.d, n.id, n.m, n.w, n.c AS least FROM p JOIN n USING (seq)),
up AS MATERIALIZED (SELECT DISTINCT lo.id, hi.id AS parent, hi.least FROM q lo JOIN q hi ON lo.c = hi.c AND lo.d = hi.d + 1),
kids AS (SELECT parent AS id, count(*) AS n_children FROM up GROUP BY 1),
below AS (SELECT DISTINCT hi.id, lo.id AS x, lo.m, lo.w FROM q hi JOIN q lo ON lo.c = hi.c AND lo.d >= hi.d),
sums AS (SELECT below.id, sum((m - 1) * w) AS saved, sum((n_children IS NULL)::INTEGER) AS leaves FROM below LEFT JOIN kids ON kids.id = x GROUP BY 1),
ends AS (SELECT id, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS e FROM (SELECT c, max_by(id, d) AS id FROM q GROUP BY c) GROUP BY id)
SELECT n.c AS conv_id, n.d AS depth, up.least AS parent_conv_id, n.m AS n_convs, CAST(coalesce(n_children, 0) AS BIGINT) AS n_children,
  CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(e, '')) AS ends_sha256
FROM n JOIN sums USING (id) LEFT JOIN up USING (id) LEFT JOIN kids USING (id) LEFT JOIN ends USING (id)
"""

OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS x FROM documents),
k AS (SELECT doc_id, x, count(*) OVER (PARTITION BY x) AS group_size, first_value(doc_id) OVER (PARTITION BY x ORDER BY length(t) DESC, doc_id) AS keep_id FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(x) AS text_sha256 FROM k
"""


def queries() -> dict:
    import corpus_pipeline

    own = (op1_ngram_jaccard_join, op2_language_id, op3_byte_bpe, op4_sharding, op5_pii_surrogates, op6_embedding_near_dedup, op7_quality, op8_suffix_dedup, op9_decontamination, op10_toxicity, op11_conversation_trie, op12_exact_dedup, op13_periodic_runs)
    return {f.__name__: f for f in own} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_jaccard_join": OP1_SQL, "op8_suffix_dedup": OP8_SQL, "op9_decontamination": OP9_SQL, "op11_conversation_trie": OP11_SQL, "op12_exact_dedup": OP12_SQL}
