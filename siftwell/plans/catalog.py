"""Each operator as a query over the driver's tables, with its SQL for DuckDB where SQL can say it.

Views: ``docs`` are documents with a path, ``syms`` parts as symbols, ``edges`` line items from order to part nodes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwell.functions import text as T
from siftwell.operators import graph as G
from siftwell.operators import maintenance as M
from siftwell.operators import postings as P
from siftwell.operators import ranking as R
from siftwell.operators import units as U
from siftwell.operators import vectors as V
from siftwell.session import parted, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def docs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").withColumn("path", F.concat_ws("/", "lang", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".md"))))


def syms(s: SparkSession, d: str) -> DataFrame:
    name = F.replace("p_name", F.lit(" "), F.lit("_"))
    return table(s, d, "part").select(
        F.col("p_partkey").alias("id"), name.alias("name"), F.concat("p_brand", F.lit("."), name).alias("qualified_name"), F.concat(F.lower("p_type"), F.lit("/"), F.lower("p_brand"), F.lit(".py")).alias("path"),
        F.col("p_size").cast("long").alias("start_line"), (F.col("p_size") + 5).cast("long").alias("end_line"),
    )


def edges(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "lineitem").select(F.concat(F.lit("o"), "l_orderkey").alias("source"), F.concat(F.lit("p"), "l_partkey").alias("target"), F.col("l_returnflag").alias("kind"), F.round(1 - F.col("l_discount"), 2).alias("confidence"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.monotonically_increasing_id().alias("row")).drop("row")


DOCS = "docs AS (SELECT *, lang || '/' || source || '/' || doc_id || '.md' AS path FROM documents)"
SYMS = """syms AS (SELECT p_partkey AS id, replace(p_name, ' ', '_') AS name, p_brand || '.' || replace(p_name, ' ', '_') AS qualified_name,
    lower(p_type) || '/' || lower(p_brand) || '.py' AS path, CAST(p_size AS BIGINT) AS start_line, CAST(p_size + 5 AS BIGINT) AS end_line FROM part)"""
EDGES = """edges AS (SELECT 'o' || l_orderkey AS source, 'p' || l_partkey AS target, l_returnflag AS kind, round(1 - l_discount, 2) AS confidence,
    CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS id FROM lineitem)"""


def sql_fold(c: str) -> str:
    return f"translate(lower({c}), '{T.FOLD_FROM}', '{T.FOLD_TO}')"


def sql_tokens(c: str) -> str:
    return f"list_filter(string_split_regex({sql_fold(c)}, '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"


def sql_camel(c: str) -> str:
    return f"regexp_replace(regexp_replace({c}, '([0-9a-z])([A-Z])', '\\1 \\2', 'g'), '([A-Z]{{1,}})([A-Z][a-z])', '\\1 \\2', 'g')"


def sql_normal(c: str) -> str:
    return f"lower(trim(regexp_replace(translate({sql_camel(f'trim({c})')}, '_-.', '   '), '\\s+', ' ', 'g')))"


def sql_fuzzy(q: str, c: str, least: float = 0.55) -> str:
    n = sql_normal(c)
    return f"""CASE WHEN {n} = '' THEN 0.0::DOUBLE WHEN {n} = '{q}' THEN 1.0::DOUBLE WHEN starts_with({n}, '{q}') THEN 0.95::DOUBLE WHEN contains({n}, '{q}') THEN 0.85::DOUBLE
        WHEN levenshtein('{q}', {n}) <= floor((1 - {least}::DOUBLE) * greatest({len(q)}, length({n})) + 1e-12) THEN 1 - levenshtein('{q}', {n})::DOUBLE / greatest({len(q)}, length({n})) ELSE 0.0::DOUBLE END"""


def sql_bm25(source: str, key: str, weights: dict[str, float], terms: list[str]) -> str:
    """CTEs that end in bm(key, bm25)."""
    words = ", ".join(f"{sql_tokens(f'coalesce({c}, chr(0))')} AS w_{c}" for c in weights)
    total = " + ".join(f"len(w_{c})" for c in weights)
    phrases = " UNION ALL ".join(f"SELECT {key}, dl, '{c}' AS col, '{t}' AS term, {w}::DOUBLE * len(list_filter(w_{c}, lambda x: x = '{t}')) AS f FROM sized" for c, w in weights.items() for t in terms)
    return f"""worded AS (SELECT {key}, {words} FROM {source}), sized AS (SELECT *, ({total})::DOUBLE AS dl FROM worded),
    stats AS (SELECT count(*)::DOUBLE AS n_all, avg(dl) AS avgdl FROM sized), found AS (SELECT * FROM ({phrases}) WHERE f > 0),
    freq AS (SELECT col, term, count(*)::DOUBLE AS n FROM found GROUP BY col, term),
    idf AS (SELECT col, term, avgdl, CASE WHEN ln((n_all - n + 0.5) / (n + 0.5)) > 0 THEN ln((n_all - n + 0.5) / (n + 0.5)) ELSE 1e-6 END AS idf FROM freq, stats),
    bm AS (SELECT {key}, sum(idf * f * 2.2::DOUBLE / (f + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS bm25 FROM found JOIN idf USING (col, term) GROUP BY {key})"""


SYMBOL_COLUMNS = ["id", "name", "qualified_name", "path", "start_line"]


@query(f"""WITH {SYMS} SELECT id, name, qualified_name, path, start_line, CASE WHEN qualified_name = 'small_ring' THEN 'exact_qualified' ELSE 'exact_short' END AS channel, 1.0::DOUBLE AS score
FROM syms WHERE qualified_name = 'small_ring' OR name = 'small_ring' ORDER BY qualified_name <> 'small_ring', path, qualified_name, start_line, id LIMIT 20""")
def exact_symbol(s, d):
    return R.exact(syms(s, d), " small_ring ", 20).select(*SYMBOL_COLUMNS, "channel", "score")


@query(f"""WITH {SYMS} SELECT id, name, qualified_name, path, start_line, 'exact_short' AS channel, 1.0::DOUBLE AS score
FROM syms WHERE name = 'red_widget' AND (path = 'EcoNomy' OR starts_with(lower(path), 'economy/')) ORDER BY path, qualified_name, start_line, id LIMIT 20""")
def exact_symbol_path(s, d):
    return R.exact(syms(s, d).filter(T.under_path(F.col("path"), T.valid_path("./EcoNomy/"))), "red_widget", 20).select(*SYMBOL_COLUMNS, "channel", "score")


@query(f"""WITH {SYMS}, scored AS (SELECT *, greatest({sql_fuzzy('smal rnig', 'name')}, {sql_fuzzy('smal rnig', 'qualified_name')}) AS s FROM syms)
SELECT id, name, qualified_name, path, start_line, round(s, 6) AS score FROM scored WHERE s >= 0.55 ORDER BY s DESC, length(qualified_name), path, qualified_name, start_line, id LIMIT 20""")
def fuzzy_symbol(s, d):
    return R.fuzzy(syms(s, d), "smalRnig", 20).select(*SYMBOL_COLUMNS, F.round("score", 6).alias("score"))


@query(f"WITH {SYMS} SELECT id, CAST(CASE WHEN levenshtein(name, 'small_ring') > 4 THEN 5 ELSE levenshtein(name, 'small_ring') END AS INTEGER) AS distance FROM syms")
def levenshtein_bounded(s, d):
    return syms(s, d).select("id", T.levenshtein_bounded(F.col("name"), F.lit("small_ring"), 4).alias("distance"))


@query(f"SELECT doc_id, {sql_normal('text')} AS normal FROM documents")
def normalize_identifier(s, d):
    return table(s, d, "documents").select("doc_id", T.normalize_identifier(F.col("text")).alias("normal"))


@query(f"SELECT doc_id, {sql_camel('text')} AS parts FROM documents")
def camel_split(s, d):
    return table(s, d, "documents").select("doc_id", T.camel_split(F.col("text")).alias("parts"))


@query(f"""WITH {SYMS}, words AS (SELECT id, x, i FROM syms, LATERAL (SELECT unnest([name, qualified_name]) AS x, unnest([1, 2]) AS i)),
found AS (SELECT id, [x] || flatten(list_transform(list_filter(string_split_regex(x, '[^A-Za-z0-9]+'), lambda y: y <> ''),
    lambda y: [y] || regexp_extract_all(regexp_replace({sql_camel('y')}, '([A-Za-z])([0-9])', '\\1 \\2', 'g'), '[A-Za-z]+|[0-9]+'))) AS l, i FROM words),
flat AS (SELECT id, lower(unnest(l)) AS t, i, generate_subscripts(l, 1) AS j FROM found), firsts AS (SELECT id, t, min(i * 100000 + j) AS o FROM flat GROUP BY id, t)
SELECT id, string_agg(t, ' ' ORDER BY o) AS terms FROM firsts GROUP BY id""")
def identifier_terms(s, d):
    return syms(s, d).select("id", F.array_join(T.identifier_terms(F.col("name"), F.col("qualified_name")), " ").alias("terms"))


@query("""WITH w AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda t: t <> '' AND length(t) <= 128) AS l FROM documents),
f AS (SELECT doc_id, t, min(i) AS i FROM (SELECT doc_id, unnest(l) AS t, generate_subscripts(l, 1) AS i FROM w) GROUP BY doc_id, t),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS r FROM f)
SELECT d.doc_id, coalesce(string_agg(t, ' ' ORDER BY i), '') AS terms FROM documents d LEFT JOIN n ON d.doc_id = n.doc_id AND r <= 32 GROUP BY d.doc_id""")
def safe_fts_terms(s, d):
    return table(s, d, "documents").select("doc_id", F.array_join(T.fts_terms(F.col("text")), " ").alias("terms"))


@query(f"SELECT doc_id, len({sql_tokens('text')}) AS tokens, len(list_distinct({sql_tokens('text')})) AS distinct_tokens FROM documents")
def tokenize_stats(s, d):
    t = T.tokens(F.col("text"))
    return table(s, d, "documents").select("doc_id", F.size(t).cast("long").alias("tokens"), F.size(F.array_distinct(t)).cast("long").alias("distinct_tokens"))


TERMS = ["tion", "nicht", "clown", "ouvipa"]
QUERY_TEXT = "Tion nicht CLOWN ouvipa"


@query(f"WITH {sql_bm25('documents', 'doc_id', {'text': 1.0}, TERMS)} SELECT doc_id, round(bm25, 6) AS score FROM bm ORDER BY score DESC, doc_id LIMIT 20")
def bm25_topk(s, d):
    hits = P.bm25(table(s, d, "documents"), "doc_id", {"text": 1.0}, T.folded_query(QUERY_TEXT))
    return hits.select("doc_id", F.round("bm25", 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(20)


@query(f"WITH {sql_bm25('documents', 'doc_id', {'source': 4.0, 'lang': 2.0, 'text': 1.0}, ['tion', 'src7', 'fr'])} SELECT doc_id, round(bm25, 6) AS score FROM bm ORDER BY score DESC, doc_id LIMIT 20")
def bm25_fields(s, d):
    hits = P.bm25(table(s, d, "documents"), "doc_id", {"source": 4.0, "lang": 2.0, "text": 1.0}, ["tion", "src7", "fr"])
    return hits.select("doc_id", F.round("bm25", 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(20)


@query(f"""WITH {DOCS} SELECT path, doc_id FROM docs WHERE path = 'FR/src1' OR starts_with(lower(path), 'fr/src1') ORDER BY path <> 'FR/src1', length(path), path, doc_id LIMIT 50""")
def path_channel(s, d):
    q = T.path_query("./FR\\src1")
    hit = docs(s, d).filter(T.path_prefix(F.col("path"), q))
    return hit.orderBy(F.when(F.col("path") == q, 0).otherwise(1), F.length("path"), "path", "doc_id").limit(50).select("path", "doc_id")


@query("""WITH k AS (SELECT doc_id, CASE CAST(substr(source, 4) AS INTEGER) % 4 WHEN 0 THEN 'imports' WHEN 1 THEN 'symbol_comment' WHEN 2 THEN 'module_docstring' END AS kind FROM documents)
SELECT doc_id, kind FROM k WHERE kind IS NULL OR kind NOT IN ('imports', 'module_docstring')""")
def intent_filter(s, d):
    kind = F.substring("source", 4, 10).cast("int") % 4
    k = table(s, d, "documents").select("doc_id", F.when(kind == 0, "imports").when(kind == 1, "symbol_comment").when(kind == 2, "module_docstring").alias("kind"))
    return k.filter(R.wanted_kind(set(T.query_terms("the comments of it")), F.col("kind")))


def lexical_channels(rows: DataFrame, text: str) -> DataFrame:
    """(channel, channel_rank, quality, identity, path, start_line, end_line, id) of all lexical channels of a query."""
    q = text.strip()
    spot = ["path", "start_line", "end_line", "id"]
    out = []
    for channel, c in (("exact_qualified", "qualified_name"), ("exact_short", "name")):
        hit = R.numbered(rows.filter(F.col(c) == q), ["path", "qualified_name", "start_line", "id"], R.LIMITS[channel])
        out.append(hit.select(F.lit(channel).alias("channel"), "channel_rank", F.lit(1.0).alias("quality"), *spot))
    if T.is_path_like(q):
        p = T.path_query(q)
        hit = R.numbered(rows.filter(T.path_prefix(F.col("path"), p)), [F.when(F.col("path") == p, 0).otherwise(1), F.length("path"), "path", "start_line", "id"], R.LIMITS["path"])
        out.append(hit.select(F.lit("path").alias("channel"), "channel_rank", F.lit(1.0).alias("quality"), *spot))
    with_terms = rows.withColumn("identifier_terms", F.array_join(T.identifier_terms(F.col("name"), F.col("qualified_name"), F.col("path")), " "))
    weights = {"name": 8.0, "qualified_name": 6.0, "identifier_terms": 4.0, "path": 2.0}
    searched = {"identifier": ["identifier_terms"], "bm25": ["name", "qualified_name", "identifier_terms"] + (["path"] if T.is_path_like(q) else [])}
    scores = P.bm25_channels(with_terms, "id", weights, T.folded_query(q), searched).join(rows, "id")
    for channel in searched:
        hit = scores.filter(F.col(channel).isNotNull()).withColumn("s", F.round(channel, 6))
        hit = R.numbered(hit, [F.desc("s"), *spot], R.LIMITS[channel])
        out.append(hit.select(F.lit(channel).alias("channel"), "channel_rank", F.lit(1.0).alias("quality"), *spot))
    near = R.numbered(R.fuzzy(rows, q, R.LIMITS["fuzzy_symbol"]), [F.desc("score"), F.length("qualified_name"), "path", "qualified_name", "start_line", "id"], R.LIMITS["fuzzy_symbol"])
    out.append(near.select(F.lit("fuzzy_symbol").alias("channel"), "channel_rank", F.col("score").alias("quality"), *spot))
    channels = out[0]
    for x in out[1:]:
        channels = channels.unionByName(x)
    return channels.withColumn("identity", F.concat(F.lit("symbol:"), F.col("id").cast("string")))


_terms = """list_distinct([lower(name), lower(qualified_name), lower(path)] || list_filter(string_split_regex(lower(name || ' ' || qualified_name || ' ' || path), '[^a-z0-9]+'), lambda y: y <> '')
    || regexp_extract_all(regexp_replace(lower(name || ' ' || qualified_name || ' ' || path), '([a-z])([0-9])', '\\1 \\2', 'g'), '[a-z]+|[0-9]+'))"""


@query(f"""WITH {SYMS}, terms AS (SELECT *, array_to_string({_terms}, ' ') AS identifier_terms FROM syms),
words AS (SELECT *, {sql_tokens('name')} AS w1, {sql_tokens('qualified_name')} AS w2, {sql_tokens('identifier_terms')} AS w3, {sql_tokens('path')} AS w4 FROM terms),
sized AS (SELECT *, (len(w1) + len(w2) + len(w3) + len(w4))::DOUBLE AS dl FROM words), stats AS (SELECT count(*)::DOUBLE AS n_all, avg(dl) AS avgdl FROM sized),
hits AS (SELECT * FROM (SELECT id, dl, c, t, CASE c WHEN 1 THEN 8.0::DOUBLE * len(list_filter(w1, lambda x: x = t)) WHEN 2 THEN 6.0::DOUBLE * len(list_filter(w2, lambda x: x = t)) ELSE 4.0::DOUBLE * len(list_filter(w3, lambda x: x = t)) END AS f
    FROM sized, (VALUES (1), (2), (3)) a(c), (VALUES ('small'), ('ring')) b(t)) WHERE f > 0),
freq AS (SELECT c, t, count(*)::DOUBLE AS n FROM hits GROUP BY c, t), idf AS (SELECT c, t, avgdl, greatest(ln((n_all - n + 0.5) / (n + 0.5)), 1e-6) AS idf FROM freq, stats),
part_scores AS (SELECT id, c, sum(idf * f * 2.2::DOUBLE / (f + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS s FROM hits JOIN idf USING (c, t) GROUP BY id, c),
ident AS (SELECT id, round(s, 6) AS s FROM part_scores WHERE c = 3), bm AS (SELECT id, round(sum(s), 6) AS s FROM part_scores GROUP BY id),
fuzz AS (SELECT *, greatest({sql_fuzzy('small ring', 'name')}, {sql_fuzzy('small ring', 'qualified_name')}) AS s FROM syms),
ranked AS (
    SELECT 0 AS ch, row_number() OVER (ORDER BY path, qualified_name, start_line, id) AS r, 50 AS m, 1.0::DOUBLE AS q, id FROM syms WHERE qualified_name = 'small_ring'
    UNION ALL SELECT 1, row_number() OVER (ORDER BY path, qualified_name, start_line, id), 50, 1.0, id FROM syms WHERE name = 'small_ring'
    UNION ALL SELECT 3, row_number() OVER (ORDER BY s DESC, path, start_line, end_line, id), 100, 1.0, id FROM ident JOIN syms USING (id)
    UNION ALL SELECT 4, row_number() OVER (ORDER BY s DESC, path, start_line, end_line, id), 100, 1.0, id FROM bm JOIN syms USING (id)
    UNION ALL SELECT 5, row_number() OVER (ORDER BY s DESC, length(qualified_name), path, qualified_name, start_line, id), 512, s, id FROM fuzz WHERE s >= 0.55),
ev AS (SELECT id, ch, r, (CASE ch WHEN 0 THEN 1.0 WHEN 1 THEN 0.96 WHEN 3 THEN 0.76 WHEN 4 THEN 0.66 ELSE 0.36 END)::DOUBLE * least(1.0::DOUBLE, greatest(0.0::DOUBLE, q / r)) AS e FROM ranked WHERE r <= m),
merged AS (SELECT id, min(ch) AS best_channel, max(e) AS m, sum(e) AS t, min(ch * 1000000 + r) AS o FROM ev GROUP BY id),
seen AS (SELECT *, row_number() OVER (ORDER BY o, 'symbol:' || id) AS n FROM merged)
SELECT 'symbol:' || id AS identity, path, CAST(best_channel AS BIGINT) AS best_channel, round(least(1.0::DOUBLE, m + 0.05::DOUBLE * (t - m)), 6) AS score FROM seen JOIN syms USING (id) WHERE n <= 500
ORDER BY best_channel, score DESC, path, start_line, end_line, id LIMIT 100""")
def lexical_merge(s, d):
    rows = syms(s, d)
    merged = R.merge_channels(lexical_channels(rows, "small_ring"), 500)
    return merged.withColumn("score", F.round("score", 6)).orderBy("best_channel", F.desc("score"), "path", "start_line", "end_line", "id").limit(100).select("identity", "path", "best_channel", "score")


def first_vector(s, d) -> list[float]:
    row = table(s, d, "embeddings").filter("vec_id = 0").select("embedding").first()
    return list(row.embedding)


DOT = "list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))"
HITS = f"hits AS (SELECT e.vec_id, e.label, round(least(1.0::DOUBLE, greatest(-1.0::DOUBLE, {DOT})), 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q)"


@query(f"WITH {HITS} SELECT vec_id, score FROM hits ORDER BY score DESC, vec_id LIMIT 20")
def vector_topk(s, d):
    return V.top_k(table(s, d, "embeddings"), first_vector(s, d), "vec_id", "embedding", 20)


@query(f"""WITH r AS (SELECT q.vec_id AS query_id, e.vec_id, round(least(1.0::DOUBLE, greatest(-1.0::DOUBLE, {DOT})), 6) AS score FROM embeddings e JOIN embeddings q ON q.vec_id % 20 = 0 AND e.vec_id <> q.vec_id),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM r) SELECT query_id, rank, vec_id, score FROM n WHERE rank <= 10""")
def vector_batch_topk(s, d):
    return V.batch_top_k(table(s, d, "embeddings"), F.col("vec_id") % 20 == 0, "vec_id", "embedding", 10)


@query(f"""WITH {HITS}, r AS (SELECT *, row_number() OVER (ORDER BY score DESC, vec_id) AS source_rank FROM hits),
s AS (SELECT *, (score + 1) / 2 AS sim, least(1.0::DOUBLE, (score + 1) / 2 + CASE WHEN label % 2 = 0 THEN 0.03::DOUBLE ELSE 0 END) AS rel FROM r WHERE source_rank <= 160),
b AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY rel DESC, sim DESC, source_rank) AS nth FROM s)
SELECT label, vec_id, source_rank, round(rel, 6) AS relevance FROM b WHERE nth = 1 AND rel >= 0.5 ORDER BY rel DESC, sim DESC, source_rank LIMIT 20""")
def semantic_collapse(s, d):
    e = table(s, d, "embeddings")
    hits = e.select("vec_id", "label", V.scored(e, first_vector(s, d), "embedding").alias("raw"))
    pool = R.numbered(hits, [F.desc("raw"), "vec_id"], 160, "source_rank")  # the evidence pool: 8 times the results
    rows = pool.select(F.col("label").alias("identity"), (F.col("label") % 2 == 0).alias("owned"), "raw", "source_rank", F.lit("").alias("path"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), F.col("vec_id").alias("id"))
    return R.semantic_collapse(rows, 20, floor=0.5).select(F.col("identity").alias("label"), F.col("id").alias("vec_id"), "source_rank", F.round("relevance", 6).alias("relevance"))


@query("""WITH n AS (SELECT len(embedding) AS d, list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) AS s FROM embeddings)
SELECT count(*) AS n, CAST(sum(4 * d) AS BIGINT) AS bytes, count(DISTINCT d) AS dimensions, round(min(s), 6) AS least_norm, round(max(s), 6) AS greatest_norm, count(*) FILTER (s < 1 - 1e-5 OR s > 1 + 1e-5) AS bad FROM n""")
def norm_check(s, d):
    return M.vector_summary(table(s, d, "embeddings"), "embedding")


@query("""WITH p AS (SELECT l_returnflag AS retriever, l_orderkey AS id, l_linenumber AS line, l_extendedprice AS score FROM lineitem)
SELECT retriever, id, line, round(CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END, 6) AS normal FROM p WINDOW w AS (PARTITION BY retriever)""")
def minmax_normalize(s, d):
    pools = table(s, d, "lineitem").select(F.col("l_returnflag").alias("retriever"), F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.col("l_extendedprice").alias("score"))
    # three retrievers: extremes from one aggregation, not from a window of a third of all rows
    ends = pools.groupBy("retriever").agg(F.min("score").alias("low"), F.max("score").alias("high"))
    normal = F.when(F.col("high") == F.col("low"), 1.0).otherwise((F.col("score") - F.col("low")) / (F.col("high") - F.col("low")))
    return pools.join(ends, "retriever").select("retriever", "id", "line", F.round(normal, 6).alias("normal"))


def pools(s, d) -> DataFrame:
    """A BM25 pool and a vector pool of 20 each, on the same ids."""
    lexical = P.bm25(table(s, d, "documents"), "doc_id", {"text": 1.0}, T.folded_query(QUERY_TEXT)).select(F.col("doc_id").alias("id"), F.round("bm25", 6).alias("score"))
    semantic = V.top_k(table(s, d, "embeddings"), first_vector(s, d), "vec_id", "embedding", 20).select(F.col("vec_id").alias("id"), "score")
    lexical, semantic = (R.numbered(p, [F.desc("score"), "id"], 20, "rank").withColumn("retriever", F.lit(r)) for p, r in ((lexical, "lexical"), (semantic, "semantic")))
    return lexical.unionByName(semantic).withColumn("path", F.concat(F.lit("doc/"), F.col("id").cast("string")))


POOLS = f"""{sql_bm25('documents', 'doc_id', {'text': 1.0}, TERMS)}, {HITS},
lex AS (SELECT 'lexical' AS retriever, doc_id AS id, round(bm25, 6) AS score, row_number() OVER (ORDER BY round(bm25, 6) DESC, doc_id) AS rank FROM bm),
sem AS (SELECT 'semantic' AS retriever, vec_id AS id, score, row_number() OVER (ORDER BY score DESC, vec_id) AS rank FROM hits),
pools AS (SELECT * FROM lex WHERE rank <= 20 UNION ALL SELECT * FROM sem WHERE rank <= 20)"""


@query(f"""WITH {POOLS}, f AS (SELECT id, sum(0.5::DOUBLE / (60 + rank)) AS raw FROM pools GROUP BY id)
SELECT 'doc/' || id AS path, id, round(raw, 9) AS raw, round(raw / max(raw) OVER (), 6) AS score FROM f ORDER BY f.raw DESC, path, id LIMIT 20""")
def rrf_fusion(s, d):
    out = R.reciprocal_rank_fusion(pools(s, d), R.weights_to_one(lexical=1, semantic=1))
    return out.select("path", "id", F.round("raw", 9).alias("raw"), F.round("score", 6).alias("score"))


@query(f"""WITH {POOLS}, n AS (SELECT *, CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0::DOUBLE ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS normal FROM pools WINDOW w AS (PARTITION BY retriever)),
f AS (SELECT id, 0.75::DOUBLE * coalesce(max(normal) FILTER (retriever = 'lexical'), 0) + 0.25::DOUBLE * coalesce(max(normal) FILTER (retriever = 'semantic'), 0) AS s FROM n GROUP BY id)
SELECT 'doc/' || id AS path, id, round(s, 6) AS score FROM f ORDER BY round(s, 6) DESC, path, id LIMIT 20""")
def weighted_fusion(s, d):
    out = R.weighted_fusion(pools(s, d), R.weights_to_one(lexical=3, semantic=1), top_k=40)
    return out.withColumn("score", F.round("score", 6)).orderBy(F.desc("score"), "path", "id").limit(20)


def candidates(s, d) -> DataFrame:
    """40 parts of lowest price as candidates of a pool; brand is the symbol, size the span."""
    p = table(s, d, "part").orderBy("p_retailprice", "p_partkey").limit(40)
    return p.select(
        F.row_number().over(Window.orderBy("p_retailprice", "p_partkey")).cast("long").alias("ordinal"), F.col("p_partkey").alias("id"), F.when(F.col("p_size") > 40, F.substring("p_brand", 7, 3).cast("long")).alias("symbol_id"),
        F.col("p_type").alias("path"), F.col("p_size").cast("long").alias("start_line"), (F.col("p_size") + 2).cast("long").alias("end_line"), F.col("p_name").alias("name"), F.length("p_name").cast("long").alias("snippet_length"), (F.col("p_size") % 2 == 0).alias("truncated"),
    )


@query("""WITH RECURSIVE c AS (SELECT row_number() OVER (ORDER BY p_retailprice, p_partkey) AS o, p_partkey AS id, CASE WHEN p_size > 40 THEN CAST(substr(p_brand, 7, 3) AS BIGINT) END AS sym, p_type AS path, p_size AS a, p_size + 2 AS b, p_name AS name,
    length(p_name) AS n, p_size % 2 = 0 AS cut FROM part ORDER BY p_retailprice, p_partkey LIMIT 40),
e AS (SELECT x.o AS u, y.o AS v FROM c x JOIN c y ON x.id = y.id OR x.sym = y.sym OR (x.path = y.path AND x.a = y.a AND x.b = y.b) OR (x.path = y.path AND x.name = y.name AND x.a <= y.b AND y.a <= x.b)),
r AS (SELECT o AS u, o AS v FROM c UNION SELECT r.u, e.v FROM r JOIN e ON r.v = e.u), g AS (SELECT u AS o, min(v) AS grp FROM r GROUP BY u),
k AS (SELECT g.grp, c.*, row_number() OVER (PARTITION BY g.grp ORDER BY n DESC, cut, (CASE WHEN sym IS NULL THEN 0 ELSE 1 END) DESC, path, a, b, name, id) AS nth, count(*) OVER (PARTITION BY g.grp) AS members FROM c JOIN g USING (o))
SELECT CAST(grp AS BIGINT) AS grp, id, members FROM k WHERE nth = 1""")
def candidate_dedupe(s, d):
    c = candidates(s, d)
    groups = R.candidate_groups(c)
    size = groups.groupBy("group").agg(F.count("*").alias("members"))
    return R.representatives(c, groups).join(size, "group").select(F.col("group").alias("grp"), "id", "members")


@query(f"""WITH {EDGES}, both_ways AS (SELECT source AS node, target AS neighbour, kind, confidence, id, 0 AS way FROM edges UNION ALL SELECT target, source, kind, confidence, id, 1 FROM edges),
n AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY way, confidence DESC, kind, neighbour, id) AS place FROM both_ways WHERE confidence >= 0.93 AND kind IN ('A', 'R'))
SELECT node, neighbour, kind, confidence, id, CAST(place AS BIGINT) AS place FROM n WHERE place <= 3""")
def adjacency_topn(s, d):
    e = edges(s, d)
    frontier = e.select(F.col("source").alias("node")).unionByName(e.select(F.col("target").alias("node")))
    return G.adjacency(e, frontier, 3, ["A", "R"], 0.93).select("node", "neighbour", "kind", "confidence", "id", F.col("place").cast("long").alias("place"))


KIND_WEIGHTS = {"A": 0.9, "R": 0.6, "N": 0.65}


def graph_seeds(s, d) -> DataFrame:
    """The five orders of greatest price are the seeds."""
    top = table(s, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(5)
    return top.select(F.concat(F.lit("o"), "o_orderkey").alias("node"), F.col("o_orderkey").alias("seed"), F.round(F.col("o_totalprice") / 1e6, 4).alias("score"))


SEEDS = "seeds AS (SELECT 'o' || o_orderkey AS node, o_orderkey AS seed, round(o_totalprice / 1e6, 4) AS score FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5)"
WEIGHT = "(CASE kind WHEN 'A' THEN 0.9 WHEN 'R' THEN 0.6 ELSE 0.65 END)::DOUBLE"
NEAR = f"""{EDGES}, {SEEDS}, both_ways AS (SELECT source AS node, target AS neighbour, kind, confidence, id, 0 AS way FROM edges WHERE confidence >= 0.55 UNION ALL SELECT target, source, kind, confidence, id, 1 FROM edges WHERE confidence >= 0.55),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY way, confidence DESC, kind, neighbour, id) AS place FROM both_ways) WHERE place <= 20),
h1 AS (SELECT neighbour AS node, seed, score, {WEIGHT} * confidence AS factor, kind, way, id AS edge FROM seeds JOIN near USING (node)),
c1 AS (SELECT *, least(1.0::DOUBLE, score * factor * 0.7::DOUBLE) AS contribution FROM h1),
b1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node, seed ORDER BY contribution DESC, kind, way, edge) AS nth FROM c1) WHERE nth = 1),
k0 AS (SELECT node, seed, score AS known FROM seeds), s1 AS (SELECT b1.*, 1 AS hop FROM b1 LEFT JOIN k0 USING (node, seed) WHERE known IS NULL OR contribution > known)"""
HOP2 = f"""k1 AS (SELECT node, seed, max(known) AS known FROM (SELECT * FROM k0 UNION ALL SELECT node, seed, contribution FROM s1) GROUP BY node, seed),
h2 AS (SELECT n.neighbour AS node, s1.seed, s1.score, s1.factor * (CASE n.kind WHEN 'A' THEN 0.9 WHEN 'R' THEN 0.6 ELSE 0.65 END)::DOUBLE * n.confidence AS factor, n.kind, n.way, n.id AS edge FROM s1 JOIN near n ON s1.node = n.node),
c2 AS (SELECT *, least(1.0::DOUBLE, score * factor * pow(0.7::DOUBLE, 2)) AS contribution FROM h2),
b2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node, seed ORDER BY contribution DESC, kind, way, edge) AS nth FROM c2) WHERE nth = 1),
s2 AS (SELECT b2.*, 2 AS hop FROM b2 LEFT JOIN k1 USING (node, seed) WHERE known IS NULL OR contribution > known)"""


def sql_choice(source: str) -> str:
    return f"best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY contribution DESC, hop, kind, way, seed, edge) AS n FROM {source} WHERE node NOT IN (SELECT node FROM seeds)) WHERE n = 1)"


BEST = "SELECT node, round(contribution, 6) AS contribution, CAST(hop AS BIGINT) AS hop, kind, CAST(way AS BIGINT) AS way, seed, edge FROM best"


@query(f"WITH {NEAR}, {sql_choice('s1')} {BEST}")
def graph_expand_1hop(s, d):
    return G.expand(graph_seeds(s, d), edges(s, d), 1, 20, KIND_WEIGHTS).withColumn("contribution", F.round("contribution", 6))


@query(f"WITH {NEAR}, {HOP2}, reached AS (SELECT * FROM s1 UNION ALL SELECT * FROM s2), {sql_choice('reached')} {BEST}")
def graph_expand_2hop(s, d):
    return G.expand(graph_seeds(s, d), edges(s, d), 2, 20, KIND_WEIGHTS).withColumn("contribution", F.round("contribution", 6))


@query(f"""WITH {NEAR}, {sql_choice('s1')}, u AS (SELECT node, score, 0 AS o FROM seeds UNION ALL SELECT node, contribution, 1 FROM best),
m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY score DESC, o) AS n FROM u) WHERE n = 1)
SELECT node, round(score, 9) AS score, o = 0 AS is_seed, row_number() OVER (ORDER BY score DESC, o, node) AS rank FROM m ORDER BY m.score DESC, o, node LIMIT 20""")
def graph_merge_rank(s, d):
    seeds = graph_seeds(s, d)
    return G.merge_results(seeds, G.expand(seeds, edges(s, d), 1, 20, KIND_WEIGHTS), 20).withColumn("score", F.round("score", 9))


def fact_rows(s, d) -> DataFrame:
    """Suppliers' numbers refer to parts by name: with a brand as scope, hint or module, or the short name alone."""
    p = table(s, d, "part")
    name = F.replace("p_name", F.lit(" "), F.lit("_"))
    return p.select(
        F.col("p_partkey").alias("id"), name.alias("target_reference"), F.when(F.col("p_size") % 3 == 0, "module").when(F.col("p_size") % 3 == 1, "symbol").otherwise("any").alias("target_kind"),
        F.when(F.col("p_type") == "ECONOMY", F.concat("p_brand", F.lit("."), name)).alias("hint"), F.when(F.col("p_type") == "ECONOMY", F.lit("explicitly_imported_symbol")).alias("hint_method"),
        F.when(F.col("p_type") == "PROMO", F.concat("p_brand", F.lit(".inner.deep"))).alias("source_scope"), F.col("p_brand").alias("module"),
    )


def node_rows(s, d) -> DataFrame:
    return syms(s, d).select("id", F.when(F.col("start_line") % 5 == 0, "module").otherwise("symbol").alias("kind"), "name", "qualified_name")


FACTS = f"""{SYMS}, nodes AS (SELECT id, CASE WHEN start_line % 5 = 0 THEN 'module' ELSE 'symbol' END AS kind, name, qualified_name FROM syms),
facts AS (SELECT p_partkey AS id, replace(p_name, ' ', '_') AS ref, CASE p_size % 3 WHEN 0 THEN 'module' WHEN 1 THEN 'symbol' ELSE 'any' END AS want, p_type, p_brand AS module FROM part),
keys AS (SELECT id, want, 0 AS p, 'explicitly_imported_symbol' AS m, module || '.' || ref AS key FROM facts WHERE p_type = 'ECONOMY'
    UNION ALL SELECT id, want, 2000 - length(sc), 'same_scope_qualified', sc || '.' || ref FROM facts, LATERAL (SELECT unnest([module, module || '.inner', module || '.inner.deep']) AS sc) WHERE p_type = 'PROMO'
    UNION ALL SELECT id, want, 3000, 'same_module_symbol', module || '.' || ref FROM facts UNION ALL SELECT id, want, 3001, 'unique_repository_qualified_match', ref FROM facts),
found AS (SELECT k.id, k.p, k.m, n.id AS node, want, kind FROM keys k JOIN nodes n ON k.key = n.qualified_name UNION ALL SELECT f.id, 4000, 'unique_short_name_match', n.id, want, kind FROM facts f JOIN nodes n ON f.ref = n.name),
per AS (SELECT id, p, m, min(node) AS lo, max(node) AS hi FROM found WHERE want = 'any' OR want = kind GROUP BY id, p, m),
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY p, m) AS n FROM per) WHERE n = 1),
resolved AS (SELECT f.id, CASE WHEN b.id IS NULL THEN 'unresolved' WHEN lo = hi THEN 'resolved' ELSE 'ambiguous' END AS status, CASE WHEN lo = hi THEN m END AS method, CASE WHEN lo = hi THEN lo END AS target FROM facts f LEFT JOIN firsts b USING (id))"""


@query(f"WITH {FACTS} SELECT * FROM resolved")
def fact_resolution(s, d):
    return G.resolve(fact_rows(s, d), node_rows(s, d)).select("id", "status", "method", "target")


@query(f"WITH {FACTS} SELECT status, count(*) AS n FROM resolved GROUP BY status")
def facts_by_status(s, d):
    return G.resolve(G.asked(fact_rows(s, d)), node_rows(s, d)).groupBy("status").agg(F.sum("n").alias("n"))


@query("""WITH x AS (SELECT 'o' || o_custkey AS a, 'o' || l_suppkey AS b, round(1 - l_discount, 2) AS c, l_orderkey * 10 + l_linenumber AS f FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
y AS (SELECT x.* FROM x JOIN customer p ON a = 'o' || p.c_custkey JOIN customer q ON b = 'o' || q.c_custkey WHERE a <> b)
SELECT a AS source, b AS target, max(c) AS confidence, CAST(arg_min(f, (-c, f)) AS BIGINT) AS fact FROM y GROUP BY a, b""")
def dependency_edges(s, d):
    lines = table(s, d, "lineitem")
    rows = lines.count()
    i = parted(lines, rows, "l_orderkey").join(table(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    name = lambda c: F.concat(F.lit("o"), c)
    imports = i.select(name("o_custkey").alias("source_path"), name("l_suppkey").alias("target_path"), F.round(1 - F.col("l_discount"), 2).alias("confidence"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("fact"))
    files = table(s, d, "customer").select(name("c_custkey").alias("path"), name("c_custkey").alias("id"))
    return G.dependencies(imports, files, rows)


def versions(s, d) -> tuple[DataFrame, DataFrame]:
    """Documents, and a later state: without toxic ones, long numbers cut out, pages added. (path, content_hash, text)."""
    old = docs(s, d).select("doc_id", "path", "text")
    toxic = table(s, d, "labels").filter("toxic = 1").select("doc_id")
    new = old.join(toxic, "doc_id", "left_anti").select("path", F.regexp_replace("text", "[0-9]{6,}", "#").alias("text"))
    pages = table(s, d, "pages").select(F.concat(F.lit("pages/"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.col("html").alias("text"))
    return tuple(x.select("path", T.content_hash(F.col("text")).alias("content_hash"), "text") for x in (old, new.unionByName(pages)))


VERSIONS = f"""{DOCS}, a AS (SELECT path, sha256(text) AS h, text FROM docs),
b AS (SELECT path, sha256(t) AS h, t AS text FROM (SELECT path, regexp_replace(text, '[0-9]{{6,}}', '#', 'g') AS t FROM docs WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) UNION ALL SELECT 'pages/' || page_id || '.html', html FROM pages)),
diff AS (SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'deleted' WHEN a.h <> b.h THEN 'changed' ELSE 'unchanged' END AS change FROM a FULL JOIN b ON a.path = b.path)"""


@query(f"WITH {VERSIONS} SELECT path, change FROM diff")
def manifest_diff(s, d):
    return M.manifest_diff(*versions(s, d))


@query(f"""WITH {VERSIONS} SELECT path, h AS content_hash FROM a WHERE path NOT IN (SELECT path FROM diff WHERE change IN ('changed', 'deleted'))
UNION ALL SELECT path, h FROM b WHERE path IN (SELECT path FROM diff WHERE change IN ('changed', 'added'))""")
def apply_updates(s, d):
    old, new = (x.select("path", "content_hash") for x in versions(s, d))
    return M.apply_updates(old, new, M.manifest_diff(old, new))


@query(f"WITH {VERSIONS}, known AS (SELECT DISTINCT h FROM a) SELECT known.h IS NOT NULL AS reused, count(*) AS n, count(DISTINCT b.h) AS hashes FROM b LEFT JOIN known ON b.h = known.h GROUP BY 1")
def embedding_reuse(s, d):
    old, new = versions(s, d)
    known = old.select("content_hash", F.col("path").alias("chunk_id"), T.hashed_vector(F.col("content_hash"), 8).alias("vector"))
    out = M.reuse_vectors(new, known, lambda text: T.hashed_vector(T.content_hash(text), 8))
    return out.groupBy("reused").agg(F.count("*").alias("n"), F.count_distinct("content_hash").alias("hashes"))


@query("SELECT o_custkey, max(o_orderkey) AS o_orderkey, any_value(t) AS o_orderdate FROM (SELECT *, max(o_orderdate) OVER (PARTITION BY o_custkey) AS t FROM orders) WHERE o_orderdate = t GROUP BY o_custkey")
def repo_latest(s, d):
    newest = table(s, d, "orders").groupBy("o_custkey").agg(F.max(F.struct("o_orderdate", "o_orderkey")).alias("m"))
    return newest.select("o_custkey", F.col("m.o_orderkey").alias("o_orderkey"), F.col("m.o_orderdate").alias("o_orderdate"))


COUNTED = ["customer", "orders", "lineitem", "part", "supplier", "documents", "embeddings", "pages"]


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in COUNTED))
def table_counts(s, d):
    return M.counts({t: table(s, d, t) for t in COUNTED})


@query("""WITH l AS (SELECT doc_id, len(string_split(rtrim(text, chr(10)), chr(10))) AS n FROM documents),
w AS (SELECT doc_id, n, CAST(unnest(range(0, CAST(greatest(1, ceil((n - 2) / 6.0)) AS BIGINT))) AS BIGINT) AS i FROM l)
SELECT doc_id, CAST(1 + i * 6 AS BIGINT) AS start_line, CAST(least(1 + i * 6 + 7, n) AS BIGINT) AS end_line FROM w""")
def line_windows(s, d):
    n = F.size(F.split(F.rtrim("text", F.lit("\n")), "\n", -1))
    w = table(s, d, "documents").select("doc_id", F.explode(U.windows(F.lit(1), n, 8, 2)).alias("w"))
    return w.select("doc_id", F.col("w.start").alias("start_line"), F.col("w.end").alias("end_line"))


def order_spans(s, d) -> DataFrame:
    return table(s, d, "lineitem").select("l_orderkey", (F.col("l_suppkey") * 2).alias("start"), (F.col("l_suppkey") * 2 + F.col("l_quantity").cast("long")).alias("end"))


MERGED = """s AS (SELECT l_orderkey, l_suppkey * 2 AS a, l_suppkey * 2 + CAST(l_quantity AS BIGINT) AS b FROM lineitem),
f AS (SELECT *, CASE WHEN a > max(b) OVER w + 1 OR max(b) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM s WINDOW w AS (PARTITION BY l_orderkey ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT *, sum(new) OVER (PARTITION BY l_orderkey ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS grp FROM f),
m AS (SELECT l_orderkey, min(a) AS a, max(b) AS b FROM g GROUP BY l_orderkey, grp)"""


@query(f"WITH {MERGED} SELECT l_orderkey, CAST(a AS BIGINT) AS start, CAST(b AS BIGINT) AS \"end\" FROM m")
def span_merge(s, d):
    return U.merged_spans(order_spans(s, d), ["l_orderkey"])


@query(f"""WITH {MERGED}, e AS (SELECT l_orderkey, a, b FROM m UNION ALL SELECT DISTINCT l_orderkey, 401, 401 FROM m), c AS (SELECT l_orderkey, a, least(b, CASE WHEN a = 401 THEN 401 ELSE 400 END) AS b FROM e WHERE a <= 401),
p AS (SELECT l_orderkey, coalesce(lag(b) OVER (PARTITION BY l_orderkey ORDER BY a, b) + 1, 1) AS start, a - 1 AS e FROM c)
SELECT l_orderkey, CAST(start AS BIGINT) AS start, CAST(e AS BIGINT) AS "end" FROM p WHERE start <= e""")
def span_gaps(s, d):
    owners = table(s, d, "lineitem").select("l_orderkey").distinct().select("l_orderkey", F.lit(1).cast("long").alias("low"), F.lit(400).cast("long").alias("high"))
    return U.span_gaps(owners, order_spans(s, d), ["l_orderkey"])


@query("""WITH l AS (SELECT doc_id, unnest(string_split(rtrim(text, chr(10)), chr(10))) AS line, generate_subscripts(string_split(rtrim(text, chr(10)), chr(10)), 1) AS i FROM documents WHERE text <> ''),
n AS (SELECT *, sum(CASE WHEN i = 1 OR regexp_matches(line, '^[A-Z][a-z]+ ') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS section FROM l)
SELECT doc_id, CAST(section AS BIGINT) AS section, CAST(min(i) AS BIGINT) AS start_line, CAST(max(i) AS BIGINT) AS end_line, string_agg(line, chr(10) ORDER BY i) AS text FROM n GROUP BY doc_id, section HAVING trim(string_agg(line, chr(10) ORDER BY i)) <> ''""")
def doc_sections(s, d):
    starts = lambda line, after: line.rlike("^[A-Z][a-z]+ ")
    return U.sections(table(s, d, "documents").withColumn("t", F.rtrim("text", F.lit("\n"))), "doc_id", F.col("t"), starts)


@query(f"""WITH {SYMS}, c AS (SELECT l_orderkey * 10 + l_linenumber AS chunk_id, l_partkey AS symbol_id, l_shipdate, 'orders/' || l_orderkey || '.md' AS path FROM lineitem)
SELECT 'symbol:' || id AS document_id, 'symbol' AS result_type, path, name, qualified_name FROM syms
UNION ALL SELECT 'chunk:' || chunk_id, 'chunk', c.path, name, qualified_name FROM c LEFT JOIN syms ON symbol_id = id""")
def lexical_documents(s, d):
    c = table(s, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("chunk_id"), F.col("l_partkey").alias("symbol_id"), F.concat(F.lit("orders/"), "l_orderkey", F.lit(".md")).alias("path"))
    return U.lexical_documents(syms(s, d), c).select("document_id", "result_type", "path", "name", "qualified_name")


@query(f"""WITH RECURSIVE {sql_bm25('documents', 'doc_id', {'text': 1.0}, TERMS)}, page AS (SELECT row_number() OVER (ORDER BY round(bm25, 6) DESC, doc_id) AS r, doc_id AS id, length(text) AS n FROM bm JOIN documents USING (doc_id) ORDER BY round(bm25, 6) DESC, doc_id LIMIT 20),
walk AS (SELECT 0::BIGINT AS r, 0::BIGINT AS used, NULL::BIGINT AS id, false AS kept, 0::BIGINT AS n UNION ALL
    SELECT p.r, CASE WHEN p.n <= 12000 AND used + p.n <= 20000 THEN used + p.n ELSE used END, p.id, p.n <= 12000 AND used + p.n <= 20000, p.n FROM walk w JOIN page p ON p.r = w.r + 1)
SELECT r AS rank, id, n AS size, kept FROM walk WHERE r > 0""")
def output_budget(s, d):
    t = table(s, d, "documents")
    hits = P.bm25(t, "doc_id", {"text": 1.0}, T.folded_query(QUERY_TEXT)).withColumn("s", F.round("bm25", 6))
    page = R.numbered(hits, [F.desc("s"), "doc_id"], 20, "rank").join(t.select("doc_id", F.length("text").cast("long").alias("size")), "doc_id")
    rows = page.select("rank", F.col("doc_id").alias("id"), "size", F.lit(False).alias("truncated"))
    return R.output_budget(rows, 12_000, 20_000).select("rank", "id", "size", "kept")


RULES = ["*.md", "!fr/*", "/de/src1*/", "src3/", "!en/src3/1*.md"]


@query(f"""WITH {DOCS} SELECT path, CASE WHEN regexp_full_match(path, 'en/src3/1.*\\.md') THEN false WHEN regexp_matches(path, '(^|/)src3/') THEN true WHEN regexp_matches(path, '^de/src1[^/]*/') THEN true
    WHEN regexp_full_match(path, 'fr/.*') THEN false ELSE true END AS ignored FROM docs""")
def gitignore_filter(s, d):
    from siftwell.sources.repository import ignored, parse_rules

    return docs(s, d).select("path", ignored(F.col("path"), parse_rules("\n".join(RULES))).alias("ignored"))


UUID_SQL = """WITH h AS (SELECT p_partkey, sha1(from_hex('6ba7b8119dad11d180b400c04fd430c8') || encode(p_name || ':' || p_partkey)) AS x FROM part)
SELECT p_partkey, substr(x, 1, 8) || '-' || substr(x, 9, 4) || '-5' || substr(x, 14, 3) || '-' || substr('89ab', (position(substr(x, 17, 1) IN '0123456789abcdef') - 1) % 4 + 1, 1) || substr(x, 18, 3) || '-' || substr(x, 21, 12) AS id FROM h"""


@query(UUID_SQL)
def uuid5_ids(s, d):
    return table(s, d, "part").select("p_partkey", T.uuid5(T.NAMESPACE, F.concat("p_name", F.lit(":"), F.col("p_partkey").cast("string"))).alias("id"))


@query(f"""WITH {DOCS} SELECT doc_id, sha256('Language: ' || lang || chr(10) || 'Path: ' || path || chr(10) || 'Kind: documentation' || chr(10) || text) AS content_hash FROM docs""")
def content_hash(s, d):
    none = F.lit(None).cast("string")
    return docs(s, d).select("doc_id", T.content_hash(T.embedding_text(F.col("lang"), F.col("path"), F.lit("documentation"), none, F.col("text"))).alias("content_hash"))


@query("""WITH h AS (SELECT doc_id, sha256(text || ':0') || sha256(text || ':1') AS x FROM documents),
r AS (SELECT doc_id, list_transform(range(0, 64), lambda i: ((position(substr(x, CAST(2 * i + 1 AS INTEGER), 1) IN '0123456789abcdef') - 1) * 16 + position(substr(x, CAST(2 * i + 2 AS INTEGER), 1) IN '0123456789abcdef') - 1)::DOUBLE / 127.5::DOUBLE - 1) AS v FROM h)
SELECT doc_id, round(v[1] / sqrt(list_dot_product(v, v)), 6) AS first, round(v[64] / sqrt(list_dot_product(v, v)), 6) AS last FROM r""")
def fake_embedding(s, d):
    v = table(s, d, "documents").select("doc_id", T.hashed_vector(F.col("text"), 64).alias("v"))
    return v.select("doc_id", F.round(F.col("v")[0], 6).alias("first"), F.round(F.col("v")[63], 6).alias("last"))


@query(f"WITH {SYMS} SELECT path || '/' || id || '.py' AS relative_path, CAST(1 AS INTEGER) AS symbols, CAST(5 AS INTEGER) AS units, CAST(3 AS INTEGER) AS nodes, CAST(4 AS INTEGER) AS facts, CAST(0 AS INTEGER) AS diagnostics FROM syms")
def python_extract(s, d):
    """Symbols, units, nodes and facts of Python sources made from the parts table."""
    from siftwell.sources.extract import parsed

    p = syms(s, d)
    body = F.concat(F.lit('"""Module."""\nimport os\n\n\n# makes it\ndef '), F.replace("name", F.lit("-"), F.lit("_")), F.lit('(x):\n    """Doc."""\n    return os.path.join(x)\n'))
    out = parsed(p.select(F.concat("path", F.lit("/"), F.col("id").cast("string"), F.lit(".py")).alias("relative_path"), F.lit("python").alias("language"), body.alias("text")))
    return out.select("relative_path", F.size("symbols").alias("symbols"), F.size("units").alias("units"), F.size("nodes").alias("nodes"), F.size("facts").alias("facts"), F.size("diagnostics").alias("diagnostics"))


@query(f"""WITH {SYMS} SELECT q, CASE WHEN n > 0 THEN 'exact' WHEN q = 'a sentence about rings' THEN 'semantic' WHEN f > 0 THEN 'fuzzy' ELSE 'semantic' END AS mode FROM (
SELECT q, (SELECT count(*) FROM syms WHERE name = q OR qualified_name = q) AS n,
    (SELECT count(*) FROM syms WHERE greatest({sql_fuzzy('smal rnig', 'name')}, {sql_fuzzy('smal rnig', 'qualified_name')}) >= 0.55) AS f FROM (VALUES ('small_ring'), ('smal_rnig'), ('a sentence about rings')) v(q))""")
def auto_route(s, d):
    from siftwell.plans.modes import route

    rows = syms(s, d)
    found = [(q, route(rows, q)) for q in ("small_ring", "smal_rnig", "a sentence about rings")]
    return s.createDataFrame(found, "q string, mode string")


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS median, quantile_disc(value, 0.95) AS p95, min(value) AS least, count(*) AS n FROM events GROUP BY event_type")
def timing_percentiles(s, d):
    e = table(s, d, "events").groupBy("event_type")
    return e.agg(F.round(F.percentile("value", 0.5), 6).alias("median"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY value)").alias("p95"), F.min("value").alias("least"), F.count("*").alias("n"))


@query("SELECT doc_id, greatest(1, len(string_split(CASE WHEN text LIKE '%' || chr(10) THEN text[:-2] ELSE text END, chr(10)))) AS n FROM documents")
def line_count(s, d):
    return table(s, d, "documents").select("doc_id", T.line_count(F.col("text")).cast("long").alias("n"))
