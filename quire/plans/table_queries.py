"""Queries over the store's tables: scans, lookups, joins, set operations, sorts, writes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quire.functions import answers, text
from quire.operators import pages as pg
from quire.operators import store
from quire.plans.registry import query, table

CHUNKS = "SELECT source AS book, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos, doc_id AS chunk, text, lang FROM documents"
PAGES = "SELECT conv_id AS book, turn + 1 AS page, role, text FROM conversations"


def chunks(spark, d):
    pos = F.row_number().over(Window.partitionBy("source").orderBy("doc_id")) - 1
    return table(spark, d, "documents").select(F.col("source").alias("book"), pos.alias("pos"), F.col("doc_id").alias("chunk"), "text", "lang")


def book_pages(spark, d):
    return table(spark, d, "conversations").select(F.col("conv_id").alias("book"), (F.col("turn") + 1).alias("page"), "role", "text")


@query("scan_chunks_in_order", f"SELECT book, pos, chunk, length(text) AS n_chars FROM ({CHUNKS}) WHERE book = 'src3' ORDER BY pos")
def scan_chunks_in_order(spark, d):
    return chunks(spark, d).where("book = 'src3'").select("book", "pos", "chunk", F.length("text").alias("n_chars")).orderBy("pos")


@query("lookup_by_ids", f"SELECT book, pos, chunk FROM ({CHUNKS}) WHERE chunk IN (SELECT item_id * 7 FROM benchmark)")
def lookup_by_ids(spark, d):
    ids = table(spark, d, "benchmark").select((F.col("item_id") * 7).alias("chunk"))
    return chunks(spark, d).join(ids, "chunk", "left_semi").select("book", "pos", "chunk")


@query("lookup_by_positions", f"SELECT book, pos, chunk FROM ({CHUNKS}) WHERE book = 'src5' AND pos IN (0, 2, 5, 900)")
def lookup_by_positions(spark, d):
    return chunks(spark, d).where((F.col("book") == "src5") & F.col("pos").isin(0, 2, 5, 900)).select("book", "pos", "chunk")


@query("pages_of_book", "SELECT conv_id AS book, string_agg((turn + 1) || ':' || length(text), ',' ORDER BY turn) AS pages FROM conversations GROUP BY conv_id")
def pages_of_book(spark, d):
    held = book_pages(spark, d).groupBy("book").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("page", "text")))).alias("m"))
    return held.select("book", F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat_ws(":", e["key"], F.length(e["value"]))), ",").alias("pages"))


@query("page_text_lookup", "SELECT c.conv_id AS book, p.page, nullif(t.text, '') AS text FROM (SELECT DISTINCT conv_id FROM conversations) c CROSS JOIN (VALUES (1), (9)) p(page) LEFT JOIN conversations t ON t.conv_id = c.conv_id AND t.turn + 1 = p.page")
def page_text_lookup(spark, d):
    asked = book_pages(spark, d).select("book").distinct().select("book", F.explode(F.array(F.lit(1), F.lit(9))).alias("page"))
    return asked.join(book_pages(spark, d), ["book", "page"], "left").select("book", "page", F.nullif("text", F.lit("")).alias("text"))


@query("summary_lookup", "SELECT conv_id AS book, turn AS chapter, text FROM conversations WHERE conv_id = 3 AND role = 'user' AND turn = 1")
def summary_lookup(spark, d):
    return table(spark, d, "conversations").where("conv_id = 3 AND role = 'user' AND turn = 1").select(F.col("conv_id").alias("book"), F.col("turn").alias("chapter"), "text")


@query("replace_partition", "SELECT conv_id AS book, turn AS at, length(text) AS n FROM conversations WHERE conv_id % 3 <> 0 UNION ALL SELECT conv_id, turn, -length(text) FROM conversations WHERE conv_id % 6 = 0")
def replace_partition(spark, d):
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("book"), F.col("turn").alias("at"), F.length("text").alias("n"))
    new = c.where("book % 6 = 0").withColumn("n", -F.col("n"))
    return store.replace_partition(c, new, c.where("book % 3 = 0").select("book"), "book")


@query("upsert_latest", "SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 4 = 0 THEN 'X' ELSE o_orderstatus END AS status FROM orders UNION ALL SELECT -o_orderkey, o_custkey, 'N' FROM orders WHERE o_orderkey % 100 = 0 AND o_orderkey > 0")
def upsert_latest(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("o_orderstatus").alias("status"))
    new = o.where("o_orderkey % 4 = 0").withColumn("status", F.lit("X")).unionByName(o.where("o_orderkey % 100 = 0 AND o_orderkey > 0").select((-F.col("o_orderkey")).alias("o_orderkey"), "o_custkey", F.lit("N").alias("status")))
    return store.upsert(o, new, ["o_orderkey", "o_custkey"])


@query("update_by_key", "SELECT o_orderkey, CASE WHEN o_custkey = 7 THEN 'ready' ELSE o_orderstatus END AS status, CASE WHEN o_custkey = 7 THEN TIMESTAMP '2026-01-01' ELSE o_orderdate END AS updated_at FROM orders")
def update_by_key(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("updated_at"))
    return store.update_by_key(o, F.col("o_custkey") == 7, {"status": F.lit("ready"), "updated_at": F.expr("TIMESTAMP_NTZ'2026-01-01 00:00:00'")}).drop("o_custkey")


@query("fail_interrupted", "SELECT o_orderkey, CASE WHEN o_orderstatus IN ('O', 'P') AND o_custkey % 2 = 0 THEN 'failed' ELSE o_orderstatus END AS status, (SELECT count(*) FROM orders WHERE o_orderstatus IN ('O', 'P') AND o_custkey % 2 = 0) AS changed FROM orders")
def fail_interrupted(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("o_orderstatus").alias("status"))
    match = F.col("status").isin("O", "P") & (F.col("o_custkey") % 2 == 0)
    changed = store.count_matches(o, match)  # one row
    return store.update_by_key(o, match, {"status": F.lit("failed")}).drop("o_custkey").withColumn("changed", F.lit(changed))


@query("cascade_delete", "SELECT 'orders' AS kind, count(*) AS n FROM orders WHERE o_orderkey % 5 <> 0 UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 5 = 0)")
def cascade_delete(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"))
    left = store.cascade_delete({"orders": orders, "lineitem": table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"))}, orders.where("k % 5 = 0"), "k")
    parts = [t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("kind"), "n") for name, t in left.items()]
    return parts[0].unionByName(parts[1])


@query("last_n_settled", "SELECT user_id, event_id FROM events WHERE event_type <> 'view' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 30")
def last_n_settled(spark, d):
    e = table(spark, d, "events").where("event_type <> 'view'")
    return store.latest(e, ["user_id"], [F.desc("ts"), F.desc("event_id")], 30).select("user_id", "event_id")


@query("drop_oldest_quarter", "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) > ceil(count(*) OVER (PARTITION BY user_id) / 4)")
def drop_oldest_quarter(spark, d):
    return store.drop_oldest_quarter(table(spark, d, "events").select("user_id", "event_id", "ts"), ["user_id"], ["ts", "event_id"]).drop("ts")


@query("add_chunks", "SELECT coalesce(d.doc_id, e.vec_id) AS doc_id, len(e.embedding) AS dim, CASE WHEN d.doc_id IS NULL THEN 'no chunk' WHEN e.vec_id IS NULL THEN 'no vector' ELSE 'paired' END AS state FROM documents d FULL JOIN embeddings e ON e.vec_id = d.doc_id")
def add_chunks(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return store.paired(table(spark, d, "documents").select("doc_id"), e, "doc_id").select("doc_id", F.when(F.col("embedding").isNotNull(), F.size("embedding")).alias("dim"), "state")


@query("insert_pending", "SELECT o_orderkey, o_orderstatus AS status FROM orders UNION ALL SELECT -1 - c_custkey, 'pending' FROM customer")
def insert_pending(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    return store.insert(o, table(spark, d, "customer").select((-1 - F.col("c_custkey")).alias("o_orderkey")), {"status": F.lit("pending")})


@query("save_evaluation", "SELECT conv_id AS book, count(*) AS n, '{\"turns\":' || count(*) || ',\"chars\":' || sum(length(text)) || '}' AS scores FROM conversations GROUP BY conv_id")
def save_evaluation(spark, d):
    c = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("book")).agg(F.count(F.lit(1)).alias("turns"), F.sum(F.length("text")).alias("chars"))
    return store.as_json(c, "scores", ["turns", "chars"]).select("book", F.get_json_object("scores", "$.turns").cast("long").alias("n"), "scores")


@query("left_join_chapter_summaries", "SELECT o.o_orderkey AS book, l.l_linenumber AS chapter, o.o_orderpriority AS title FROM lineitem l LEFT JOIN orders o ON o.o_orderkey = l.l_orderkey AND o.o_totalprice > 100000 ORDER BY 1, 2")
def left_join_chapter_summaries(spark, d):
    o = table(spark, d, "orders").where("o_totalprice > 100000").select("o_orderkey", "o_orderpriority")
    j = table(spark, d, "lineitem").join(o, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return j.select(F.col("o_orderkey").alias("book"), F.col("l_linenumber").alias("chapter"), F.col("o_orderpriority").alias("title")).orderBy("book", "chapter")


@query("neighbour_join", f"WITH c AS ({CHUNKS}) SELECT h.book, h.pos AS centre, n.pos FROM c h JOIN c n ON n.book = h.book AND abs(n.pos - h.pos) <= 1 AND (n.pos = h.pos OR n.lang = h.lang)")
def neighbour_join(spark, d):
    from quire.operators.retrieval import neighbours

    c = chunks(spark, d).withColumnRenamed("lang", "chapter")
    return neighbours(c.select("book", "pos", F.lit(1).alias("rank")), c).select("book", "centre", "pos")


SPANS = "SELECT book, row_number() OVER (PARTITION BY book ORDER BY page) - 1 AS chapter, page AS start, greatest(coalesce(lead(page) OVER (PARTITION BY book ORDER BY page) - 1, last_page), page) AS \"end\", title FROM (SELECT conv_id AS book, turn + 1 AS page, max(turn + 1) OVER (PARTITION BY conv_id) AS last_page, role, left(text, 20) AS title FROM conversations) WHERE role = 'user'"


def spans(spark, d):
    p = book_pages(spark, d)
    starts = p.where("role = 'user'").select("book", F.col("page").alias("start"), F.substring("text", 1, 20).alias("title"))
    return pg.chapter_spans(starts, p.groupBy("book").agg(F.max("page").alias("last_page")))


@query("chapter_spans", SPANS)
def chapter_spans(spark, d):
    return spans(spark, d).select("book", "chapter", "start", "end", "title")


@query("page_chapter_range_join", f"SELECT p.book, p.page, coalesce(s.chapter, -1) AS chapter FROM ({PAGES}) p LEFT JOIN ({SPANS}) s ON s.book = p.book AND p.page BETWEEN s.start AND s.\"end\"")
def page_chapter_range_join(spark, d):
    return pg.pages_in_chapters(book_pages(spark, d), spans(spark, d))


@query("citation_overlap_join", f"SELECT DISTINCT a.book, a.chapter AS cited, b.chapter AS passage FROM ({SPANS}) a JOIN ({SPANS}) b ON a.book = b.book AND a.start <= b.\"end\" + 1 AND b.start <= a.\"end\" + 1")
def citation_overlap_join(spark, d):
    s = spans(spark, d)
    cited = s.select("book", F.col("chapter").alias("cited"), F.explode(F.sequence(F.col("start"), F.col("end") + 1)).alias("page"))
    shown = s.select("book", F.col("chapter").alias("passage"), F.explode(F.sequence(F.col("start"), F.col("end") + 1)).alias("page"))
    return cited.join(shown, ["book", "page"]).select("book", "cited", "passage").distinct()


@query("quote_containment_join", "SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def quote_containment_join(spark, d):
    from quire.operators.retrieval import containing

    return containing(table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "benchmark").select("item_id", F.col("text").alias("quote")))


@query("page_hit_rate", "SELECT round(sum(hit::INT)::DOUBLE / nullif(count(*), 0), 3) AS hit_rate, count(*) AS n, sum(hit::INT) AS found FROM (SELECT l.doc_id, bool_or(c.turn + 1 = l.doc_id % 5 + 1) AS hit FROM labels l JOIN conversations c ON c.conv_id = l.doc_id % 100 AND c.role = 'user' WHERE l.quality = 1 AND l.toxic = 0 GROUP BY 1)")
def page_hit_rate(spark, d):
    cases = table(spark, d, "labels").where("quality = 1 AND toxic = 0").select("doc_id", (F.col("doc_id") % 100).alias("book"), (F.col("doc_id") % 5 + 1).alias("expected"))
    cited = book_pages(spark, d).where("role = 'user'").groupBy("book").agg(F.collect_set("page").alias("cited"))
    hit = cases.join(cited, "book").select(F.arrays_overlap("cited", F.array("expected")).alias("hit"))
    found, n = F.count_if("hit"), F.count(F.lit(1))
    return hit.agg(F.round(F.try_divide(found, n), 3).alias("hit_rate"), n.alias("n"), found.alias("found"))


@query("extraction_stats", "SELECT book, count(*) AS pages, count(*) FILTER (role = 'user') AS digital, count(*) FILTER (role = 'assistant') AS ocr, count(*) FILTER (role = 'system') AS empty, sum(length(text))::BIGINT AS chars FROM (" + PAGES + ") GROUP BY book")
def extraction_stats(spark, d):
    kind = F.when(F.col("role") == "user", "digital").when(F.col("role") == "assistant", "ocr").otherwise("empty")
    return pg.extraction_stats(book_pages(spark, d).withColumn("source", kind))


@query("chunking_stats", "SELECT s.source AS book, count(text) AS chunks, coalesce(round(avg(length(text)), 1), 0) AS mean, coalesce(min(length(text)), 0) AS least, coalesce(max(length(text)), 0) AS most FROM (SELECT DISTINCT source FROM documents UNION ALL SELECT 'no chunks') s LEFT JOIN documents d USING (source) GROUP BY s.source")
def chunking_stats(spark, d):
    c = chunks(spark, d)
    books = c.select("book").distinct().unionByName(spark.createDataFrame([("no chunks",)], "book string"))
    return pg.chunking_stats(c.select("book", F.length("text").alias("tokens")), books)


@query("refusal_metrics", "SELECT round(count(*) FILTER (quality = 0 AND toxic = 1)::DOUBLE / nullif(count(*) FILTER (quality = 0), 0), 3) AS refusal_recall, round(count(*) FILTER (quality = 1 AND toxic = 1)::DOUBLE / nullif(count(*) FILTER (quality = 1), 0), 3) AS false_refusal_rate, count(*) FILTER (quality = 0) AS unanswerable, count(*) FILTER (quality = 0 AND toxic = 1) AS correct_refusals, count(*) FILTER (quality = 1) AS answerable, count(*) FILTER (quality = 1 AND toxic = 1) AS false_refusals FROM labels")
def refusal_metrics(spark, d):
    from quire.operators.evaluation import refusal_metrics as metrics

    return metrics(table(spark, d, "labels").select((F.col("quality") == 1).alias("answerable"), (F.col("toxic") == 0).alias("found")))


@query("library_counts", "SELECT count(*) AS books, count(*) FILTER (o_orderstatus IN ('O', 'P')) AS busy FROM orders")
def library_counts(spark, d):
    return table(spark, d, "orders").agg(F.count(F.lit(1)).alias("books"), F.count_if(F.col("o_orderstatus").isin("O", "P")).alias("busy"))


@query("evaluation_report", "SELECT conv_id AS case_id, count(*) AS n, round(avg(turn), 2) AS mean_rewrites, string_agg(DISTINCT (turn + 1)::VARCHAR, ',' ORDER BY (turn + 1)::VARCHAR) AS pages FROM conversations GROUP BY conv_id")
def evaluation_report(spark, d):
    c = table(spark, d, "conversations")
    pages = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.sequence(F.col("turn") + 1, F.col("turn") + 1)))))
    return c.groupBy(F.col("conv_id").alias("case_id")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("turn"), 2).alias("mean_rewrites"), F.array_join(pages.cast("array<string>"), ",").alias("pages"))


@query("chunk_assembly", "SELECT conv_id AS book, turn // 3 AS window, min(turn + 1) AS page_start, max(turn + 1) AS page_end, sum(length(text))::BIGINT AS tokens, string_agg(text, ' ' ORDER BY turn) AS text FROM conversations GROUP BY 1, 2")
def chunk_assembly(spark, d):
    c = table(spark, d, "conversations").withColumn("window", F.expr("turn div 3"))
    return c.groupBy(F.col("conv_id").alias("book"), "window").agg(
        F.min(F.col("turn") + 1).alias("page_start"), F.max(F.col("turn") + 1).alias("page_end"), F.sum(F.length("text")).alias("tokens"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), " ").alias("text"),
    )


@query("section_ranges", f"SELECT book, chapter // 2 AS section, min(start) AS page_start, max(start) AS page_end FROM ({SPANS}) GROUP BY 1, 2")
def section_ranges(spark, d):
    return spans(spark, d).groupBy("book", F.expr("chapter div 2").alias("section")).agg(F.min("start").alias("page_start"), F.max("start").alias("page_end"))


@query("monotone_headings", "SELECT user_id AS book, event_id AS \"at\", value::INT AS number FROM events QUALIFY value::INT > coalesce(max(value::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)")
def monotone_headings(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("book"), F.col("event_id").alias("at"), F.rint("value").cast("int").alias("number"))
    return pg.monotone(e)


@query("consecutive_runs", f"SELECT book, min(pos) AS first, max(pos) AS last, count(*) AS n FROM (SELECT book, pos, pos - row_number() OVER (PARTITION BY book ORDER BY pos) AS run FROM ({CHUNKS}) WHERE lang = 'en') GROUP BY book, run")
def consecutive_runs(spark, d):
    run = F.col("pos") - F.row_number().over(Window.partitionBy("book").orderBy("pos"))
    return chunks(spark, d).where("lang = 'en'").select("book", "pos", run.alias("run")).groupBy("book", "run").agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.count(F.lit(1)).alias("n")).drop("run")


@query("list_newest_first", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_custkey = 11 ORDER BY o_orderdate DESC, o_orderkey")
def list_newest_first(spark, d):
    return table(spark, d, "orders").where("o_custkey = 11").select("o_orderkey", "o_orderdate").orderBy(F.desc("o_orderdate"), "o_orderkey")


@query("owned_only", "SELECT o_orderkey FROM orders WHERE o_custkey::VARCHAR = '10'")
def owned_only(spark, d):
    return table(spark, d, "orders").where(F.col("o_custkey").cast("string") == "10").select("o_orderkey")


@query("ready_only", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 200 ELSE 409 END AS status FROM orders")
def ready_only(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", 200).otherwise(409).alias("status"))


@query("latest_per_key", "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def latest_per_key(spark, d):
    return store.latest(table(spark, d, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("sample_chunks", f"SELECT chunk, nullif(text, '') AS sample FROM ({CHUNKS}) WHERE book = 'src1' ORDER BY pos LIMIT 5")
def sample_chunks(spark, d):
    return chunks(spark, d).where("book = 'src1'").orderBy("pos").limit(5).select("chunk", F.nullif("text", F.lit("")).alias("sample"))


@query("pages_shown", f"SELECT book, string_agg(DISTINCT page::VARCHAR, ',' ORDER BY page::VARCHAR) AS pages FROM (SELECT book, unnest(range(start, \"end\" + 1)) AS page FROM ({SPANS})) GROUP BY book")
def pages_shown(spark, d):
    s = spans(spark, d).groupBy("book").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.sequence("start", "end"))))).alias("p"))
    return s.select("book", F.array_join(F.array_sort(F.col("p").cast("array<string>")), ",").alias("pages"))


@query("cited_not_shown", f"SELECT book, page FROM ({PAGES}) EXCEPT SELECT book, unnest(range(start, \"end\" + 1)) FROM ({SPANS})")
def cited_not_shown(spark, d):
    shown = spans(spark, d).select("book", F.explode(F.sequence("start", "end")).alias("page"))
    return book_pages(spark, d).select("book", "page").exceptAll(shown).distinct()


@query("contents_halves", "SELECT book, pos, ntile(2) OVER (PARTITION BY book ORDER BY pos) AS half FROM (" + CHUNKS + ") QUALIFY count(*) OVER (PARTITION BY book) > 6")
def contents_halves(spark, d):
    w = Window.partitionBy("book")
    return chunks(spark, d).select("book", "pos", F.ntile(2).over(w.orderBy("pos")).alias("half"), F.count(F.lit(1)).over(w).alias("n")).where("n > 6").drop("n")


@query("citation_projection", "SELECT doc_id, 'પાનું ' || (doc_id % 50) || ' | ' || lang AS citation, left(text, 300) AS snippet FROM documents")
def citation_projection(spark, d):
    page = (F.col("doc_id") % 50).cast("string")
    return table(spark, d, "documents").select("doc_id", answers.citation_label(page, page, F.col("lang")).alias("citation"), F.substring("text", 1, 300).alias("snippet"))


@query("search_all_words", "SELECT c_custkey FROM customer WHERE contains(lower(c_name || ' ' || c_mktsegment), 'customer') AND contains(lower(c_name || ' ' || c_mktsegment), 'build')")
def search_all_words(spark, d):
    key = text.search_key(F.concat_ws(" ", "c_name", "c_mktsegment"))
    return table(spark, d, "customer").where(text.holds_all_words(key, "customer build")).select("c_custkey")


@query("history_filter", "SELECT conv_id, turn FROM conversations WHERE contains(lower(text), 'the') AND contains(lower(text), 'of')")
def history_filter(spark, d):
    return table(spark, d, "conversations").where(text.holds_all_words(F.lower("text"), "the of")).select("conv_id", "turn")


@query("rate_limit_admission", """
WITH RECURSIVE e AS (SELECT event_id, user_id, event_type, epoch(ts) AS t, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events),
s AS (SELECT event_id, user_id, event_type, n, true AS admitted, 0 AS wait_minutes, [t] AS held FROM e WHERE n = 1
  UNION ALL
  SELECT e.event_id, e.user_id, e.event_type, e.n, len(list_filter(s.held, lambda x: e.t - x < 604800)) < 2,
    CASE WHEN len(list_filter(s.held, lambda x: e.t - x < 604800)) < 2 THEN 0 ELSE floor((604800 - (e.t - list_filter(s.held, lambda x: e.t - x < 604800)[1])) / 60)::INT + 1 END,
    CASE WHEN len(list_filter(s.held, lambda x: e.t - x < 604800)) < 2 THEN list_append(list_filter(s.held, lambda x: e.t - x < 604800), e.t) ELSE list_filter(s.held, lambda x: e.t - x < 604800) END
  FROM s JOIN e ON e.user_id = s.user_id AND e.event_type = s.event_type AND e.n = s.n + 1)
SELECT event_id AS id, admitted, wait_minutes FROM s
""")
def rate_limit_admission(spark, d):
    from quire.operators.grouped import admission

    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return admission(table(spark, d, "events").select(F.col("user_id").alias("user"), F.col("event_type").alias("action"), at.alias("at"), F.col("event_id").alias("id")), 2, 604800)


@query("budget_batches", """
WITH RECURSIVE c AS (SELECT source AS book, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos, greatest(1, length(text) // 3) AS w FROM documents),
s AS (SELECT book, pos, 0 AS batch, w AS used FROM c WHERE pos = 0
  UNION ALL SELECT c.book, c.pos, CASE WHEN s.used > 0 AND s.used + c.w > 6000 THEN s.batch + 1 ELSE s.batch END, CASE WHEN s.used > 0 AND s.used + c.w > 6000 THEN c.w ELSE s.used + c.w END
  FROM s JOIN c ON c.book = s.book AND c.pos = s.pos + 1)
SELECT book, pos, batch FROM s
""")
def budget_batches(spark, d):
    from quire.operators.grouped import budget_batches as batches

    return batches(chunks(spark, d).select("book", F.col("pos"), F.greatest(F.lit(1), F.floor(F.length("text") / 3)).cast("int").alias("weight")), 6000)


#: Sentences of a conversation's pages, those over {size} estimated tokens cut into pieces of as many words as reach it (no word of the tables is Gujarati).
UNITS = r"""
t AS (SELECT conv_id AS book, turn + 1 AS page, list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '\n\s*\n', chr(1), 'g'), '([।॥?!.])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS l FROM conversations),
x AS (SELECT book, page, unnest(l) AS sentence, generate_subscripts(l, 1) AS k FROM t), w AS (SELECT *, list_filter(regexp_split_to_array(sentence, '\s+'), lambda y: y <> '') AS w FROM x),
z AS (SELECT list_min(list_filter(range(1, {size} + 1), lambda y: floor(y * 1.3::DOUBLE)::INT + 1 >= {size})) AS step),
i AS (SELECT book, page, k, unnest(CASE WHEN floor(len(w) * 1.3::DOUBLE)::INT + 1 > {size} THEN list_transform(range(0, len(w), step), lambda a: array_to_string(w[a + 1:a + step], ' ')) ELSE [sentence] END) AS sentence, generate_subscripts(CASE WHEN floor(len(w) * 1.3::DOUBLE)::INT + 1 > {size} THEN range(0, len(w), step) ELSE [0] END, 1) AS p FROM w, z),
units AS (SELECT book, page, row_number() OVER (PARTITION BY book, page ORDER BY k, p) - 1 AS n, sentence, floor(len(list_filter(regexp_split_to_array(sentence, '\s+'), lambda y: y <> '')) * 1.3::DOUBLE)::INT + 1 AS tokens FROM i)"""
#: Windows over units u(book, chapter, pos, tokens): each step appends a unit, to the open window or to a new one that begins with the old one's longest tail within the overlap.
WINDOWS = """
o AS (SELECT *, row_number() OVER (PARTITION BY book, chapter ORDER BY pos) AS k FROM u),
s AS (SELECT book, chapter, k, 0 AS win, [{'pos': pos, 'tokens': tokens}] AS held, [pos] AS added FROM o WHERE k = 1
  UNION ALL SELECT book, chapter, k, win + CASE WHEN closes THEN 1 ELSE 0 END, list_append(CASE WHEN closes THEN tail ELSE held END, unit), list_append(CASE WHEN closes THEN list_transform(tail, lambda x: x.pos) ELSE [] END, unit.pos)
  FROM (SELECT s.book, s.chapter, o.k, s.win, s.held, {'pos': o.pos, 'tokens': o.tokens} AS unit, list_sum(list_transform(s.held, lambda x: x.tokens)) + o.tokens > {size} AS closes,
    s.held[list_min(list_filter(range(1, len(s.held) + 2), lambda a: coalesce(list_sum(list_transform(s.held[a:], lambda x: x.tokens)), 0) <= {overlap})):] AS tail
    FROM s JOIN o ON o.book = s.book AND o.chapter = s.chapter AND o.k = s.k + 1)),
packed AS (SELECT book, chapter, win AS "window", unnest(added) AS pos FROM s)"""


def packing_sql(units: str, size: int, overlap: int, select: str) -> str:
    windows = WINDOWS.replace("{size}", str(size)).replace("{overlap}", str(overlap))
    return f"WITH RECURSIVE {UNITS.replace('{size}', str(size))},\nu AS ({units}),{windows}\n{select}"


@query("pack_windows", packing_sql("SELECT book, -1 AS chapter, page * 1000000 + n AS pos, tokens FROM units", 40, 12, "SELECT * FROM packed"))
def pack_windows(spark, d):
    """Small windows, so that long sentences are cut and windows overlap."""
    from quire.operators.grouped import pack_windows as packed, sentence_units

    units = sentence_units(book_pages(spark, d).select("book", "page", "text"), 40)
    return packed(units.select("book", F.lit(-1).alias("chapter"), (F.col("page") * 1_000_000 + F.col("n")).alias("pos"), "tokens"), 40, 12)


@query("chunk_documents", packing_sql(
    f"SELECT units.book, coalesce(c.chapter, -1) AS chapter, units.page * 1000000 + n AS pos, tokens FROM units LEFT JOIN ({SPANS}) c ON c.book = units.book AND units.page BETWEEN c.start AND c.\"end\"", 60, 20,
    f"""SELECT g.book, chapter, page_start, page_end, token_count, text, chunk_index, g.book || ':' || chunk_index AS chunk_id, coalesce(s.title, '') AS chapter_title FROM (
    SELECT p.book, p.chapter, p."window", min(page) AS page_start, max(page) AS page_end, sum(tokens)::BIGINT AS token_count, string_agg(sentence, ' ' ORDER BY p.pos) AS text, row_number() OVER (PARTITION BY p.book ORDER BY p.chapter, p."window") - 1 AS chunk_index
    FROM packed p JOIN units ON units.book = p.book AND units.page * 1000000 + units.n = p.pos GROUP BY p.book, p.chapter, p."window") g LEFT JOIN ({SPANS}) s USING (book, chapter)""",
))
def chunk_documents(spark, d):
    from quire.operators.ingestion import chunk_pages

    return chunk_pages(book_pages(spark, d), spans(spark, d), size=60, overlap=20)
