"""Table-level queries of the operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat_format, exact_dedup, fingerprints, language_id, line_dedup, ngram_join, packing, sentencepiece_codec, sharding, warc

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode_documents(table(spark, sf_dir, "documents"), piece_model())


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=85, with_links=True).select("doc_id", "n_shingles", "component_id", "class_id", "n_links")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), shards=40)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.remove_boilerplate(table(spark, sf_dir, "documents"), counts=True).select("doc_id", "text", "n_chars", "n_lines", "n_removed")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.format_conversations(table(spark, sf_dir, "conversations"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_edited(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


OPERATORS: list[Query] = [
    op1_best_fit_packing,
    op2_sentencepiece,
    op3_ngram_jaccard,
    op4_warc,
    op5_sharding,
    op6_line_dedup,
    op7_exact_dedup,
    op8_chat_format,
    op9_fingerprints,
    op10_language_id,
]

def _feistel(left: str, right: str) -> str:
    """SQL of one pass of the permutation: the rounds written out."""
    for step in range(sharding.ROUNDS):
        left, right = right, f"(({left} + ('0x' || substr(md5(concat({right}, ':', {sharding.SEED}, ':', {step})), 1, 15))::BIGINT % side) % side)"
    return f"({left} * side + {right})"


SHARD_SQL = f"""
WITH RECURSIVE bytes AS (
  SELECT list(c ORDER BY i) AS crc_of FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, _: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END) AS c
    FROM (SELECT unnest(range(256))::BIGINT AS i))
), d AS (
  SELECT doc_id, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT) AS b FROM documents
), z AS (
  SELECT doc_id, CAST(len(b) + 16 AS BIGINT) AS size,
         xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(crc_of[(xor(c, x) & 255) + 1], c // 256)), 4294967295) AS text_crc32 FROM d, bytes
), n AS (SELECT count(*) AS n, greatest(1, CAST(ceil(sqrt(count(*))) AS BIGINT)) AS side FROM documents),
r AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS k FROM z),
walk AS (
  SELECT k, {_feistel("(k // side)", "(k % side)")} AS v, 1 AS step FROM r, n
  UNION ALL SELECT k, {_feistel("(v // side)", "(v % side)")} AS v, step + 1 AS step FROM walk, n WHERE v >= n
), p AS (SELECT k, CAST(arg_max(v, step) AS BIGINT) AS position FROM walk GROUP BY k)
SELECT doc_id, size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'rows' AS law, CAST(position % 40 AS INTEGER) AS shard, position // 40 AS slot, CAST(NULL AS INTEGER) AS grown_shard, position
FROM r JOIN p ON r.k = p.k
"""

WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, html, strlen(html) AS n, sha1(html) AS digest FROM p),
k AS (SELECT html, max(page_id) AS last FROM d WHERE n >= 1000 GROUP BY html)
SELECT d.page_id, CAST(d.n AS BIGINT) AS payload_bytes, d.digest AS payload_digest,
       CASE WHEN k.last IS NULL OR k.last = d.page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN k.last <> d.page_id THEN k.last END AS refers_to, u.url
FROM d LEFT JOIN k ON d.html = k.html JOIN (SELECT page_id, coalesce(url, '') AS url FROM pages) u ON u.page_id = d.page_id
"""

LINE_SQL = r"""
WITH l AS (
  SELECT doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
  FROM documents
), b AS (
  SELECT *, regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', '') AS bare FROM l
), bad AS (
  SELECT bare, min(doc_id) AS first_doc FROM b WHERE bare <> '' GROUP BY bare HAVING count(DISTINCT source) >= 5
), kept AS (
  SELECT b.doc_id, count(*) AS n_lines, count(*) FILTER (WHERE bad.bare IS NOT NULL AND b.doc_id <> bad.first_doc) AS n_removed,
         coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE bad.bare IS NULL OR b.doc_id = bad.first_doc), '') AS text
  FROM b LEFT JOIN bad ON b.bare = bad.bare GROUP BY b.doc_id
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE k.text END AS text,
       CAST(CASE WHEN k.n_removed > 0 THEN length(k.text) ELSE d.n_chars END AS BIGINT) AS n_chars,
       CAST(CASE WHEN d.text IS NULL THEN 0 ELSE k.n_lines END AS BIGINT) AS n_lines, CAST(k.n_removed AS BIGINT) AS n_removed
FROM documents d JOIN kept k ON d.doc_id = k.doc_id
"""

NGRAM_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END)) AS s FROM w
), c AS (SELECT s, min(doc_id) AS class_id, count(*) AS docs, len(s) AS n FROM s WHERE len(s) > 0 GROUP BY s),
u AS (SELECT class_id, n, unnest(s) AS g FROM c),
p AS (SELECT a.class_id AS a, b.class_id AS b FROM u a JOIN u b ON a.g = b.g AND a.class_id <> b.class_id
  GROUP BY a.class_id, b.class_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
r AS (SELECT class_id AS a, class_id AS b FROM c UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
k AS (SELECT a AS class_id, min(b) AS component_id FROM r GROUP BY a),
l AS (SELECT p.a AS class_id, sum(c.docs) AS linked FROM p JOIN c ON c.class_id = p.b GROUP BY p.a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(k.component_id, s.doc_id) AS component_id, c.class_id,
       CAST(coalesce(c.docs - 1 + coalesce(l.linked, 0), 0) AS BIGINT) AS n_links
FROM s LEFT JOIN c ON s.s = c.s LEFT JOIN k ON k.class_id = c.class_id LEFT JOIN l ON l.class_id = c.class_id
"""

DEDUP_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY norm)
SELECT n.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, n.doc_id = g.keep_id AS kept, sha256(n.norm) AS text_sha256
FROM n JOIN g ON n.norm = g.norm
"""

CHAT_SQL = r"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, replace(coalesce(text, ''), '<|', '< |') AS said,
         replace(trim(regexp_replace(coalesce(role, ''), '[\x20\x09-\x0D]+', ' ', 'g'), ' '), '<|', '< |') AS name,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, c.role NULLS FIRST, text NULLS FIRST) - 1 AS seq
  FROM conversations c
), s AS (SELECT DISTINCT conv_id, role AS perspective FROM t WHERE role <> '' AND role <> 'system'),
v AS (
  SELECT t.conv_id, s.perspective, t.seq // 256 AS block, t.seq, t.role = s.perspective AS own,
         CASE WHEN t.role = s.perspective THEN '<|im_start|>assistant' || chr(10)
              WHEN t.role = 'system' THEN '<|im_start|>system' || chr(10)
              WHEN t.role = '' THEN '<|im_start|>user' || chr(10)
              ELSE '<|im_start|>user name=' || t.name || chr(10) END AS head,
         t.said || '<|im_end|>' AS body
  FROM t JOIN s ON t.conv_id IS NOT DISTINCT FROM s.conv_id
), o AS (
  SELECT *, coalesce(sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, perspective ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
            + length(head) AS place FROM v
)
SELECT conv_id, perspective, CAST(block AS BIGINT) AS block, CAST(min(place - length(head)) AS BIGINT) AS block_start, CAST(count(*) AS BIGINT) AS n_turns,
       CAST(count(*) FILTER (WHERE own) AS BIGINT) AS n_assistant, string_agg(head || body || chr(10), '' ORDER BY seq) AS rendered,
       list({'start': CAST(place AS BIGINT), 'stop': CAST(place + length(body) AS BIGINT)} ORDER BY seq) FILTER (WHERE own) AS mask
FROM o GROUP BY conv_id, perspective, block
"""


def queries() -> dict[str, Query]:
    return {q.__name__: q for q in OPERATORS}


def oracle_sql() -> dict[str, str]:
    return {"op3_ngram_jaccard": NGRAM_SQL, "op4_warc": WARC_SQL, "op5_sharding": SHARD_SQL, "op6_line_dedup": LINE_SQL, "op7_exact_dedup": DEDUP_SQL, "op8_chat_format": CHAT_SQL}
