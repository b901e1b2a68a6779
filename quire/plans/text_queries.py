"""Queries over document text: cleaning, counts, tokens, page furniture, retrieval."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quire.functions import answers, text
from quire.operators import pages as pg
from quire.operators import retrieval as rt
from quire.plans.registry import query, table
from quire.plans.table_queries import book_pages

STOP = ", ".join(f"'{w}'" for w in text.STOPWORDS)
TOKENS = f"list_filter(string_split(lower(regexp_replace(text, '[^\\p{{L}}\\p{{N}}\\p{{M}}]+', ' ', 'g')), ' '), lambda w: w <> '' AND w NOT IN ({STOP}))"


def docs(spark, d):
    return table(spark, d, "documents")


@query("clean_text", r"SELECT doc_id, trim(regexp_replace(array_to_string(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(replace(replace(nfc_normalize(text), chr(13) || chr(10), chr(10)), chr(13), chr(10)), '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x{9f}\x{fffd}]', '', 'g'), '(\w)-\n(\w)', '\1\2', 'g'), '[ \t\x{a0}]+', ' ', 'g'), chr(10)), lambda x: trim(x)), chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10) || chr(9)) AS clean FROM documents")
def clean_text(spark, d):
    return docs(spark, d).select("doc_id", text.clean_text(F.col("text")).alias("clean"))


@query("letter_count", r"SELECT doc_id, length(regexp_replace(text, '\P{L}+', '', 'g')) AS letters FROM documents")
def letter_count(spark, d):
    return docs(spark, d).select("doc_id", text.letter_count(F.col("text")).alias("letters"))


@query("readable_letter_count", r"SELECT doc_id, length(regexp_replace(regexp_replace(text, '[\x{80}-\x{24f}]+', '', 'g'), '\P{L}+', '', 'g')) AS letters FROM documents")
def readable_letter_count(spark, d):
    return docs(spark, d).select("doc_id", text.readable_letter_count(F.col("text")).alias("letters"))


@query("legacy_encoded", r"SELECT doc_id, n >= 60 AND (n - r) / n::DOUBLE > 0.3 AS legacy FROM (SELECT doc_id, length(regexp_replace(text, '\P{L}+', '', 'g')) AS n, length(regexp_replace(regexp_replace(text, '[\x{80}-\x{24f}]+', '', 'g'), '\P{L}+', '', 'g')) AS r FROM documents)")
def legacy_encoded(spark, d):
    return docs(spark, d).select("doc_id", F.coalesce(text.legacy_encoded(F.col("text")), F.lit(False)).alias("legacy"))


@query("page_source_routing", r"WITH c AS (SELECT doc_id, text AS t, CASE WHEN doc_id % 3 = 0 THEN upper(text) || ' again' END AS o FROM documents), n AS (SELECT *, length(regexp_replace(t, '\P{L}+', '', 'g')) AS l, length(regexp_replace(regexp_replace(t, '[\x{80}-\x{24f}]+', '', 'g'), '\P{L}+', '', 'g')) AS r, length(regexp_replace(regexp_replace(o, '[\x{80}-\x{24f}]+', '', 'g'), '\P{L}+', '', 'g')) AS ro FROM c), g AS (SELECT *, l >= 60 AND (l - r) / l::DOUBLE > 0.3 AS legacy FROM n) SELECT doc_id, CASE WHEN (legacy OR l < 60) AND coalesce(ro > CASE WHEN legacy THEN 0 ELSE r END, false) THEN 'ocr' WHEN legacy OR trim(t) = '' THEN 'empty' ELSE 'digital' END AS source FROM g")
def page_source_routing(spark, d):
    p = docs(spark, d).select("doc_id", "text", F.when(F.col("doc_id") % 3 == 0, F.concat(F.upper("text"), F.lit(" again"))).alias("ocr_text"))
    return pg.route_sources(p).select("doc_id", "source")


@query("tokenize", f"SELECT doc_id, len({TOKENS}) AS n, array_to_string({TOKENS}, ' ') AS tokens FROM documents")
def tokenize(spark, d):
    t = docs(spark, d).select("doc_id", text.tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").alias("n"), F.array_join("t", " ").alias("tokens"))


@query("estimate_tokens", r"SELECT doc_id, CASE WHEN n = 0 THEN 0 ELSE floor(n * 1.3::DOUBLE)::INT + 1 END AS tokens FROM (SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS n FROM documents)")
def estimate_tokens(spark, d):
    return docs(spark, d).select("doc_id", text.estimate_tokens(F.col("text")).alias("tokens"))


@query("split_sentences", r"SELECT doc_id, unnest(range(len(s))) AS n, unnest(s) AS sentence FROM (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '\n\s*\n', chr(1), 'g'), '([।॥?!.])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS s FROM documents)")
def split_sentences(spark, d):
    return docs(spark, d).select("doc_id", F.posexplode(text.sentences(F.col("text"))).alias("n", "sentence"))


@query("parse_chunk_id", "SELECT doc_id, source AS book, doc_id::INT AS pos FROM documents")
def parse_chunk_id(spark, d):
    cid = F.concat_ws(":", "source", F.col("doc_id").cast("string"))
    return docs(spark, d).select("doc_id", F.regexp_extract(cid, "^(.*):[^:]*$", 1).alias("book"), F.substring_index(cid, ":", -1).try_cast("int").alias("pos"))


@query("distinct_in_order", r"SELECT doc_id, string_agg(w, ' ' ORDER BY p) AS words FROM (SELECT doc_id, w, min(p) AS p FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS p FROM documents) GROUP BY doc_id, w) GROUP BY doc_id")
def distinct_in_order(spark, d):
    return docs(spark, d).select("doc_id", F.array_join(F.array_distinct(F.split("text", " ")), " ").alias("words"))


HEADED = r"regexp_matches(x, '^#{1,6}\s+\S') AND NOT regexp_matches(x, '^#{1,6}\s+:$')"
BOLD = r"regexp_matches(x, '^(\*\*[^*]{1,80}\*\*|__[^_]{1,80}__)\s*:?$')"
ITEM = r"regexp_matches(regexp_replace(x, '\*\*|__', '', 'g'), '^([-*•]|[0-9]+[.)]|[૦-૯]+[.)])\s+')"


@query("answer_blocks", rf"""
WITH l AS (SELECT doc_id, unnest(list_filter(list_transform(regexp_split_to_array(text, '\n+'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')) AS x, generate_subscripts(list_filter(list_transform(regexp_split_to_array(text, '\n+'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''), 1) AS k FROM documents),
b AS (SELECT doc_id, k, CASE WHEN {HEADED} OR {BOLD} THEN 'heading' WHEN {ITEM} THEN 'item' ELSE 'paragraph' END AS kind,
  CASE WHEN {HEADED} THEN trim(regexp_replace(regexp_replace(regexp_replace(x, '^#{{1,6}}\s+', ''), '\s*:$', ''), '\*\*|__', '', 'g')) WHEN {BOLD} THEN trim(regexp_replace(regexp_replace(x, '\s*:$', ''), '\*\*|__', '', 'g'))
  WHEN {ITEM} THEN regexp_replace(regexp_replace(x, '\*\*|__', '', 'g'), '^([-*•]|[0-9]+[.)]|[૦-૯]+[.)])\s+', '') ELSE regexp_replace(x, '\*\*|__', '', 'g') END AS text FROM l)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS n, kind, text FROM b WHERE text <> ''""")
def answer_blocks(spark, d):
    return docs(spark, d).select("doc_id", F.posexplode(answers.answer_blocks(F.col("text"))).alias("n", "block")).select("doc_id", "n", "block.kind", "block.text")


BODY = r"regexp_replace(regexp_replace(c.text, '(?i)(?:પાનું|પાનાં|પાના|પૃષ્ઠ|pages?|p\.)\s*([0-9૦-૯][0-9૦-૯\s,\-‐‑–—]*)', ' ', 'g'), '(?m)^\s*(?:[-*•]\s*)?[0-9૦-૯]+[.)]\s', ' ', 'g')"


@query("unsupported_numbers", rf"SELECT c.conv_id, c.turn, unnest(list_filter(list_distinct(regexp_extract_all({BODY}, '[0-9]+')), lambda n: NOT list_contains(regexp_extract_all(d.text, '[0-9]+'), n))) AS number FROM conversations c JOIN documents d ON d.doc_id = c.conv_id")
def unsupported_numbers(spark, d):
    from quire.operators.grounding import missing_numbers

    p = docs(spark, d).select(F.col("doc_id").alias("conv_id"), F.col("text").alias("corpus"))
    c = table(spark, d, "conversations").select("conv_id", "turn", "text").join(p, "conv_id")
    return c.select("conv_id", "turn", F.explode(missing_numbers(F.col("text"), F.col("corpus"))).alias("number"))


@query("quote_exact", "SELECT b.item_id, count(*) AS holders FROM benchmark b JOIN documents d ON contains(regexp_replace(d.text, '\\s+', ' ', 'g'), regexp_replace(b.text, '\\s+', ' ', 'g')) GROUP BY 1")
def quote_exact(spark, d):
    from quire.operators.retrieval import containing

    flat = lambda t: F.trim(F.regexp_replace(t, r"\s+", " "))
    held = containing(docs(spark, d).select("doc_id", flat("text").alias("text")), table(spark, d, "benchmark").select("item_id", flat("text").alias("quote")))
    return held.groupBy("item_id").agg(F.count(F.lit(1)).alias("holders"))


@query("format_pages", "SELECT l_orderkey, l_linenumber, CASE WHEN l_suppkey <= l_linenumber THEN 'p. ' || l_linenumber ELSE 'pp. ' || l_linenumber || '–' || l_suppkey END AS label FROM lineitem")
def format_pages(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", answers.format_pages(F.col("l_linenumber"), F.col("l_suppkey")).alias("label"))


@query("format_duration", "SELECT event_id, CASE WHEN s < 60 THEN s || ' s' ELSE (s // 60) || ' min ' || lpad((s % 60)::VARCHAR, 2, '0') || ' s' END AS label FROM (SELECT event_id, greatest(0, round(value))::INT AS s FROM events)")
def format_duration(spark, d):
    return table(spark, d, "events").select("event_id", answers.format_duration(F.col("value")).alias("label"))


@query("format_passages", "SELECT source AS book, string_agg('[' || pos || '] page ' || doc_id || ' | chapter: ' || lang || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY pos) AS prompt FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS pos FROM documents) WHERE pos <= 5 GROUP BY source")
def format_passages(spark, d):
    pos = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    block = F.concat(F.format_string("[%d] page %d | chapter: %s\n", F.col("pos"), F.col("doc_id"), F.col("lang")), F.col("text"))
    top = docs(spark, d).withColumn("pos", pos).where("pos <= 5").groupBy(F.col("source").alias("book")).agg(F.array_sort(F.collect_list(F.struct("pos", block.alias("block")))).alias("b"))
    return top.select("book", F.array_join(F.transform("b", lambda x: x["block"]), "\n\n---\n\n").alias("prompt"))


def line_books(spark, d):
    """Books by source: each document a page."""
    page = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    return docs(spark, d).select(F.col("source").alias("book"), page.alias("page"), "text")


LINES = r"WITH p AS (SELECT source AS book, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS page, text FROM documents), x AS (SELECT book, page, unnest(range(len(l))) AS k, trim(unnest(l)) AS line FROM (SELECT book, page, string_split(text, chr(10)) AS l FROM p)), n AS (SELECT *, row_number() OVER (PARTITION BY book, page ORDER BY k) AS up, row_number() OVER (PARTITION BY book, page ORDER BY k DESC) AS down FROM x WHERE line <> ''), s AS (SELECT book, count(*) AS pages FROM p GROUP BY book)"


@query("running_headers", LINES + " SELECT n.book, n.line, count(DISTINCT n.page) AS on_pages FROM n JOIN s USING (book) WHERE up <= 2 OR down <= 2 GROUP BY n.book, n.line HAVING NOT regexp_matches(n.line, '^[0-9]{1,4}$') AND count(DISTINCT n.page) >= greatest(3, floor(max(s.pages) * 0.04)) AND max(s.pages) >= 5")
def running_headers(spark, d):
    return pg.running_lines(line_books(spark, d), 0.04)


PAGE_LINES = r"WITH p AS (SELECT user_id AS book, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS page, (value::INT % 7 + row_number() OVER (PARTITION BY user_id ORDER BY event_id))::VARCHAR AS line FROM events)"


def numbered_pages(spark, d):
    page = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    return table(spark, d, "events").select(F.col("user_id").alias("book"), page.alias("page"), (F.pmod(F.rint("value").cast("int"), F.lit(7)) + page).cast("string").alias("text"))


@query("folio_offset", PAGE_LINES + ", v AS (SELECT book, page - line::INT AS delta, 2 * count(*) AS hits, min(page) AS first FROM p WHERE length(line) <= 4 GROUP BY 1, 2), b AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY book ORDER BY hits DESC, first) = 1) SELECT b.book, delta, hits FROM b JOIN (SELECT book, count(*) AS n FROM p GROUP BY book) s USING (book) WHERE hits >= greatest(3, n // 10)")
def folio_offset(spark, d):
    return pg.folio_offset(numbered_pages(spark, d))


#: Pages with their printed number, three less than the page's own, as a last line.
PRINTED = r"p AS (SELECT source AS book, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS page, text || chr(10) || (row_number() OVER (PARTITION BY source ORDER BY doc_id) + 3) AS text FROM documents)"


def bare(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def furniture(x: str) -> str:
    """SQL for a blank, running or page-number line."""
    return f"({bare(x)} = '' OR list_contains(coalesce(running, []), {bare(x)}) OR coalesce(regexp_matches({bare(x)}, '^[0-9]{{1,4}}$') AND TRY_CAST({bare(x)} AS INT) = page - delta, false))"


def leading(lines: str) -> str:
    """SQL for how many of the first two lines are furniture."""
    return f"CASE WHEN len({lines}) > 0 AND {furniture(f'{lines}[1]')} THEN CASE WHEN len({lines}) > 1 AND {furniture(f'{lines}[2]')} THEN 2 ELSE 1 END ELSE 0 END"


@query("strip_running_headers", f"""
WITH {PRINTED}, x AS (SELECT book, page, unnest(l) AS raw, generate_subscripts(l, 1) AS k FROM (SELECT book, page, string_split(text, chr(10)) AS l FROM p)),
n AS (SELECT book, page, line, row_number() OVER (PARTITION BY book, page ORDER BY k) AS up, row_number() OVER (PARTITION BY book, page ORDER BY k DESC) AS down, k FROM (SELECT *, {bare('raw')} AS line FROM x) WHERE line <> ''),
z AS (SELECT book, count(*) AS pages FROM p GROUP BY book),
r AS (SELECT book, list(line) AS running FROM (SELECT n.book, line FROM n JOIN z USING (book) WHERE (up <= 2 OR down <= 2) AND NOT regexp_matches(line, '^[0-9]{{1,4}}$') GROUP BY n.book, line HAVING max(pages) >= 5 AND count(DISTINCT page) >= greatest(3, floor(max(pages) * 0.04))) GROUP BY book),
e AS (SELECT book, page, line, 0 AS side, k FROM n WHERE up <= 2 UNION ALL SELECT book, page, line, 1, k FROM n WHERE down <= 2),
v AS (SELECT book, page - line::INT AS delta, count(*) AS hits, min((page, side, k)) AS first FROM e WHERE regexp_matches(line, '^[0-9]{{1,4}}$') GROUP BY 1, 2),
o AS (SELECT v.book, delta FROM (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY book ORDER BY hits DESC, first) = 1) v JOIN z USING (book) WHERE hits >= greatest(3, pages // 10)),
t AS (SELECT p.book, page, text, pages, running, delta, string_split(text, chr(10)) AS l FROM p JOIN z USING (book) LEFT JOIN r USING (book) LEFT JOIN o USING (book)),
u AS (SELECT *, l[({leading('l')}) + 1:] AS rest FROM t), w AS (SELECT *, list_reverse(rest) AS back FROM u),
q AS (SELECT *, list_reverse(back[({leading('back')}) + 1:]) AS kept FROM w)
SELECT book, page, CASE WHEN pages < 5 THEN text ELSE {bare('array_to_string(kept, chr(10))')} END AS text FROM q""")
def strip_running_headers(spark, d):
    p = line_books(spark, d).withColumn("text", F.concat("text", F.lit("\n"), (F.col("page") + 3).cast("string")))
    return pg.strip_running_lines(p, share=0.04)


NORM = "sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)))"


@query("normalize_vectors", f"SELECT vec_id, unnest(range(len(embedding))) AS at, round(unnest(list_transform(embedding, lambda x: x::DOUBLE / {NORM})), 6) AS value FROM embeddings")
def normalize_vectors(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", F.posexplode(rt.unit(F.col("embedding"))).alias("at", "value"))
    return v.withColumn("value", F.round("value", 6))


#: Rows whose id is divisible by this are queries.
QUERY_STEP = 100


def query_vectors(spark, d):
    return table(spark, d, "embeddings").where(F.col("vec_id") % QUERY_STEP == 0).select(F.col("vec_id").alias("query"), F.col("embedding").alias("asked"))


def vector_chunks(spark, d):
    return table(spark, d, "embeddings").select(F.col("label").alias("book"), F.col("vec_id").alias("chunk"), F.col("vec_id").alias("pos"), F.col("embedding").alias("vector"))


@query("vector_topk", "WITH q AS (SELECT vec_id AS query, list_transform(embedding, lambda x: x::DOUBLE) AS a FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT query, label AS book, vec_id AS chunk, list_cosine_similarity(list_transform(embedding, lambda x: x::DOUBLE), a) AS s FROM embeddings, q), r AS (SELECT *, row_number() OVER (PARTITION BY query, book ORDER BY round(1 - s, 9), chunk) AS rank FROM s) SELECT query, book, chunk, round(s, 6) AS score, rank FROM r WHERE rank <= 10")
def vector_topk(spark, d):
    return rt.vector_topk(vector_chunks(spark, d), query_vectors(spark, d)).withColumn("score", F.round("score", 6))


def query_texts(spark, d):
    return table(spark, d, "benchmark").where(F.col("item_id") % QUERY_STEP == 0).select(F.col("item_id").alias("query"), "text")


def text_chunks(spark, d):
    return docs(spark, d).select(F.col("source").alias("book"), F.col("doc_id").alias("chunk"), F.col("doc_id").alias("pos"), "text")


BM25 = f"""
w AS (SELECT source AS book, doc_id AS chunk, CASE WHEN len({TOKENS}) = 0 THEN [chr(0)] ELSE {TOKENS} END AS t FROM documents),
l AS (SELECT book, chunk, len(t) AS n FROM w), a AS (SELECT book, count(*) AS docs, avg(n) AS avgdl FROM l GROUP BY book),
tf AS (SELECT book, chunk, token, count(*) AS tf FROM (SELECT book, chunk, unnest(t) AS token FROM w) GROUP BY ALL),
df AS (SELECT book, token, count(*) AS df FROM tf GROUP BY ALL), i0 AS (SELECT df.*, ln(docs - df + 0.5) - ln(df + 0.5) AS raw FROM df JOIN a USING (book)),
i AS (SELECT book, token, df, CASE WHEN raw < 0 THEN 0.25 * avg(raw) OVER (PARTITION BY book) ELSE raw END AS idf FROM i0),
q AS (SELECT item_id AS query, token, count(*) AS times FROM (SELECT item_id, unnest({TOKENS}) AS token FROM benchmark WHERE item_id % 100 = 0) GROUP BY ALL),
s AS (SELECT query, tf.book, tf.chunk, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / avgdl))) AS s FROM q JOIN tf USING (token) JOIN i ON i.book = tf.book AND i.token = tf.token JOIN l ON l.book = tf.book AND l.chunk = tf.chunk JOIN a ON a.book = tf.book GROUP BY ALL HAVING s > 0),
b AS (SELECT *, row_number() OVER (PARTITION BY query, book ORDER BY round(s, 9) DESC, chunk) AS rank FROM s)"""


@query("bm25_corpus_stats", f"WITH {BM25} SELECT book, token, df, round(idf, 6) AS idf FROM i")
def bm25_corpus_stats(spark, d):
    return rt.corpus_stats(rt.bm25_index(text_chunks(spark, d)))[1].withColumn("idf", F.round("idf", 6))


@query("bm25_topk", f"WITH {BM25} SELECT query, book, chunk, round(s, 6) AS score, rank FROM b WHERE rank <= 10")
def bm25_topk(spark, d):
    return rt.bm25_topk(text_chunks(spark, d), query_texts(spark, d)).withColumn("score", F.round("score", 6))


RRF = "sum(1 / (60.0::DOUBLE + rank))"


@query("rrf_fusion", f"WITH x AS (SELECT l_suppkey AS book, l_orderkey AS chunk, 0 AS list, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rank FROM lineitem), y AS (SELECT l_suppkey AS book, l_orderkey AS chunk, 1 AS list, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity DESC, l_orderkey, l_linenumber) AS rank FROM lineitem), u AS (SELECT * FROM x WHERE rank <= 10 UNION ALL SELECT * FROM y WHERE rank <= 10), s AS (SELECT book, chunk, {RRF} AS s, min(list * 1000 + rank) AS f FROM u GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY round(s, 9) DESC, f, chunk) AS rank FROM s) SELECT book, chunk, round(s, 6) AS score, rank FROM r WHERE rank <= 5")
def rrf_fusion(spark, d):
    def ranked(by: str):
        w = Window.partitionBy("l_suppkey").orderBy(F.desc(by), "l_orderkey", "l_linenumber")
        return table(spark, d, "lineitem").select(F.lit(0).alias("query"), F.col("l_suppkey").alias("book"), F.col("l_orderkey").alias("chunk"), F.row_number().over(w).alias("rank")).where("rank <= 10")

    return rt.fuse([("price", ranked("l_extendedprice")), ("quantity", ranked("l_quantity"))]).select("book", "chunk", F.round("score", 6).alias("score"), "rank")


@query("hybrid_search", f"""
WITH {BM25},
vq AS (SELECT vec_id AS query, list_transform(embedding, lambda x: x::DOUBLE) AS a FROM embeddings WHERE vec_id % 100 = 0),
xq AS (SELECT vec_id - 1 AS query, list_transform(embedding, lambda x: x::DOUBLE) AS a FROM embeddings WHERE vec_id % 100 = 1),
c AS (SELECT source AS book, doc_id AS chunk, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM documents JOIN embeddings ON vec_id = doc_id),
v AS (SELECT *, row_number() OVER (PARTITION BY query, book ORDER BY round(1 - s, 9), chunk) AS rank FROM (SELECT query, book, chunk, list_cosine_similarity(v, a) AS s FROM c, vq)),
e AS (SELECT *, row_number() OVER (PARTITION BY query, book ORDER BY round(1 - s, 9), chunk) AS rank FROM (SELECT query, book, chunk, list_cosine_similarity(v, a) AS s FROM c, xq)),
u AS (SELECT query, book, chunk, 0 AS list, rank, s FROM b WHERE rank <= 10 UNION ALL SELECT query, book, chunk, 1, rank, s FROM v WHERE rank <= 10 UNION ALL SELECT query, book, chunk, 2, rank, s FROM e WHERE rank <= 10),
f AS (SELECT query, book, chunk, {RRF} AS s, min(list * 1000 + rank) AS f, max(rank) FILTER (list = 0) AS bm25_rank, max(u.s) FILTER (list = 0) AS bm25_score, coalesce(max(rank) FILTER (list = 1), max(rank) FILTER (list = 2)) AS vector_rank, coalesce(max(u.s) FILTER (list = 1), max(u.s) FILTER (list = 2)) AS vector_score FROM u GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query, book ORDER BY round(s, 9) DESC, f, chunk) AS rank FROM f)
SELECT query, book, chunk, round(s, 6) AS score, rank, bm25_rank, round(bm25_score, 6) AS bm25_score, vector_rank, round(vector_score, 6) AS vector_score, text FROM r JOIN documents ON doc_id = chunk WHERE rank <= 5""")
def hybrid_search(spark, d):
    """The second wording's vector is that of the next id."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk"), F.col("embedding").alias("vector"))
    c = text_chunks(spark, d).join(v, "chunk", "left")
    second = v.where(F.col("chunk") % QUERY_STEP == 1).select((F.col("chunk") - 1).alias("query"), F.col("vector").alias("extra"))
    q = query_texts(spark, d).join(query_vectors(spark, d), "query", "full").join(second, "query", "full")
    found = rt.hybrid_search(c, q, script=None)
    return found.select("query", "book", "chunk", F.round("score", 6).alias("score"), "rank", "bm25_rank", F.round("bm25_score", 6).alias("bm25_score"), "vector_rank", F.round("vector_score", 6).alias("vector_score"), "text")


@query("widen_passages", """
WITH c AS (SELECT conv_id AS book, turn AS pos, turn + 1 AS page_start, turn + 1 + turn % 2 AS page_end, text, turn // 3 AS chapter, role FROM conversations),
h AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY length(text) DESC, pos) AS rank FROM c QUALIFY rank <= 2),
n AS (SELECT c.book, c.pos, max(c.text) AS text, min(c.page_start) AS low, max(c.page_end) AS high, min(h.rank) FILTER (c.pos = h.pos) AS rank FROM h JOIN c ON c.book = h.book AND abs(c.pos - h.pos) <= 1 AND c.chapter = h.chapter GROUP BY 1, 2),
r AS (SELECT *, pos - row_number() OVER (PARTITION BY book ORDER BY pos) AS run FROM n),
m AS (SELECT book, min(pos) AS first, max(pos) AS last, min(low) AS page_start, max(high) AS page_end, min(rank) AS rank, list(text ORDER BY pos) AS parts FROM r GROUP BY book, run),
j AS (SELECT *, list_reduce(parts, lambda a, b: CASE WHEN list_min(list_filter(range(1, length(a) - 6), lambda p: length(b) >= 8 AND starts_with(b, substr(a, p)))) IS NULL THEN a || ' ' || b ELSE left(a, list_min(list_filter(range(1, length(a) - 6), lambda p: starts_with(b, substr(a, p)))) - 1) || b END) AS text FROM m)
SELECT j.book, CASE WHEN first < last THEN j.book || ':' || first || '-' || last ELSE j.book || ':' || h.pos END AS chunk, j.text, j.page_start, j.page_end, j.rank, h.pos, h.chapter, h.role FROM j JOIN h ON h.book = j.book AND h.rank = j.rank""")
def widen_passages(spark, d):
    at = F.col("turn")
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("book"), at.alias("pos"), (at + 1).alias("page_start"), (at + 1 + at % 2).alias("page_end"), "text", F.expr("turn div 3").alias("chapter"), "role")
    rank = F.row_number().over(Window.partitionBy("book").orderBy(F.length("text").desc(), "pos"))
    hits = c.withColumn("rank", rank).withColumn("chunk", F.concat_ws(":", F.col("book").cast("string"), F.col("pos").cast("string")))
    return rt.widen_passages(hits, c, 2)
