"""One query per operator over the driver's tables, with production parameters, and its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm import attribution, dartminhash, langid, linefreq, lpf, packing, permindex, replytree, topk, unigram
from siftwell.session import table


def bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pieces_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_cross_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    texts = langid.labelled_text(docs, ~held_out)
    out = langid.predict(docs.select("doc_id", "text"), texts)
    return out.select(F.col("row.doc_id").alias("doc_id"), F.coalesce(F.crc32(F.col("row.doc_id").cast("string")) % 4 == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op2_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = r"\### Assistant: </turn> ok"
    own = spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    read = replytree.digests(replytree.formatted(replytree.chain(turns, "conv_id", "turn"), best=1))
    return read.select(F.col("tree.conv_id").alias("conv_id"), "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def op3_section_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribution.section_tokens(table(spark, sf_dir, "documents"), bpe_path())


def op4_unigram_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram.encoded(table(spark, sf_dir, "documents"), pieces_path())


def op5_related_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), bpe_path())


def op6_site_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", linefreq.host_of("url").alias("host"), linefreq.page_lines("html").alias("text"))
    out = linefreq.stripped(pages, "host")
    return out.select(F.col("row.page_id").alias("page_id"), F.col("row.host").alias("host"), "n_lines", "n_dropped", F.col("kept").alias("kept_text"))


def op7_longest_previous_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lpf.removal_report(table(spark, sf_dir, "documents"))


def op8_norm_sorted_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_inner(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("vec_id") % 100 == 0, 10)


def op9_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permindex.nearest(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("vec_id") % 20 == 0, 20)


def op10_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dartminhash.classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_cross_parsing, op2_reply_trees, op3_section_tokens, op4_unigram_pieces, op5_related_packing, op6_site_lines, op7_longest_previous_factor, op8_norm_sorted_topk, op9_permutation_index, op10_dart_minhash)
}

CONVERSATIONS = r"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
    UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), sized AS (
    SELECT *, 6 + 9 + length(replace(replace(replace(text, '\', '\\'), '<', '\l'), '#', '\h'))
        + length(replace(replace(replace(replace(replace(role, '\', '\\'), '<', '\l'), '#', '\h'), ':', '\c'), chr(10), '\n')) AS chars
    FROM turns
)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, md5(text))) AS turns_sha256,
    CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, md5(text)), '')) AS loss_sha256,
    CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id"""

LINES = f"""
WITH hosted AS (
    SELECT row_number() OVER () AS r, page_id, lower(nullif(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), '')) AS host,
        regexp_replace(html, '{linefreq.BLOCK_TAG}', chr(10), 'gi') AS text FROM pages
), lines AS (
    SELECT r, page_id, host, l.line AS line, l.nth AS nth, trim(l.line, E' \\t\\r\\v\\f') AS core
    FROM (FROM hosted WHERE text IS NOT NULL) d, LATERAL (SELECT unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS nth) l
), totals AS (
    SELECT host, count(*) AS pages FROM hosted WHERE text IS NOT NULL GROUP BY host
), common AS (
    SELECT l.host, l.core FROM (SELECT DISTINCT r, host, core FROM lines WHERE core <> '') l JOIN totals t ON l.host = t.host
    GROUP BY l.host, l.core, t.pages HAVING count(*) >= {linefreq.LEAST_HOLDERS} AND count(*) > CAST({linefreq.RATIO} AS DOUBLE) * t.pages
), judged AS (
    SELECT l.*, c.core IS NOT NULL AS gone FROM lines l LEFT JOIN common c ON l.host = c.host AND l.core = c.core
)
SELECT any_value(page_id) AS page_id, any_value(host) AS host, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
    coalesce(string_agg(line, chr(10) ORDER BY nth) FILTER (NOT gone), '') AS kept_text
FROM judged GROUP BY r
UNION ALL SELECT page_id, host, 0, 0, NULL FROM hosted WHERE text IS NULL"""

PRODUCTS = f"""
WITH whole AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({topk.SCALE} * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
    FROM whole q JOIN whole c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
), ranked AS (
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10"""


REPEATS = """
WITH texts AS (
    SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), stretches AS (
    SELECT r, doc_id, k, substr(h, 400 * k + 1, 498) AS c FROM texts, LATERAL (SELECT unnest(range(0, length(h) // 400 + 1)) AS k) WHERE doc_id IS NOT NULL
), strings AS (
    SELECT r, doc_id, 200 * k + j AS i, substr(c, 2 * j + 1, 100) AS s FROM stretches, LATERAL (SELECT unnest(range(0, greatest(0, length(c) // 2 - 49))) AS j)
), firsts AS (
    SELECT s, min(doc_id) AS first FROM strings GROUP BY s
), gone AS (
    SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS before FROM strings JOIN firsts USING (s) WHERE first < doc_id
), numbered AS (
    SELECT r, i, sum(CASE WHEN before IS NULL OR i > before + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) AS run FROM gone
), runs AS (
    SELECT r, min(i) AS a, max(i) + 50 AS b FROM numbered GROUP BY r, run
), edges AS (
    SELECT r, a, b FROM runs UNION ALL SELECT r, length(h) // 2, length(h) // 2 FROM texts
), pieces AS (
    SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a, b), 0) AS start FROM edges
)
SELECT any_value(doc_id) AS doc_id, CAST(any_value(length(h)) // 2 AS BIGINT) AS n_bytes, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) - 1 AS n_spans,
    sha256(unhex(string_agg(substr(h, 2 * start + 1, 2 * (a - start)), '' ORDER BY a, b))) AS kept_sha256
FROM pieces JOIN texts USING (r) GROUP BY r"""

SQL: dict[str, str] = {"op2_reply_trees": CONVERSATIONS, "op6_site_lines": LINES, "op7_longest_previous_factor": REPEATS, "op8_norm_sorted_topk": PRODUCTS}
