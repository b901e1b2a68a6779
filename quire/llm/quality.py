"""Quality rules with adaptive thresholds.

Each document is measured with DataFrame functions alone. Thresholds are fences around the quartiles of its
(lang, source): a metric beyond q3 + FENCE * max(q3 - q1, its slack) rejects (for word length also below q1).
Quartiles come from a mergeable sketch of integers: values fall into buckets that keep their STEP_BITS leading
bits, and a sketch is the counts by bucket. Counts add, so group, language and corpus share one aggregation with
map-side partial sums, exact to the bucket and the same in any order. A group under MIN_ROWS rows takes its
language's quartiles, a language under it the corpus's.

Defined results: null text has no words and is rejected by the fixed rule (n_words under MIN_WORDS). Null lang and
null source are values of their own. Repeated rows count and are judged as often as they come. An empty table
gives none. The input row travels in a struct, so extra columns never clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.common import broadcast_if_small, stage

MIN_WORDS = 50
MIN_ROWS = 100
FENCE = 8
STEP_BITS = 6
#: By metric: the least spread that counts, in the metric's own unit. Word length has 20 hundredths of a character, so that
#: with FENCE both its fences lie within what texts reach: good documents keep within 1 of their quartiles, fences stand 1.6 apart.
SLACK = {"symbol_pm": 25, "word_length_pc": 20, "dup_line_pm": 60, "repeat_pm": 60, "upper_pm": 50}
#: Metrics that also have a lower fence.
BOTH_SIDES = {"word_length_pc"}

_SPACE = r"[\x20\x09-\x0D]+"


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeated(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more."""

    def covered(windows: Column) -> Column:
        pairs = F.array_sort(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))

        def twice(p: Column) -> Column:
            same = F.filter(p, lambda x, i: ((i > 0) & (F.get(p, i - 1)["w"] == x["w"])) | (F.coalesce(F.get(p, i + 1)["w"] == x["w"], F.lit(False))))
            starts = F.array_sort(F.transform(same, lambda x: x["i"]))
            # a start covers its window up to the next start
            return _let(starts, lambda s: F.aggregate(F.transform(s, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(s, i + 1) - x, F.lit(3)))), F.lit(0), lambda a, b: a + b))

        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(_let(pairs, twice))

    windows = F.transform(F.sequence(F.lit(1), F.size(words) - 2), lambda i: F.concat_ws(" ", F.element_at(words, i), F.element_at(words, i + 1), F.element_at(words, i + 2)))
    return F.when(F.size(words) < 4, F.lit(0)).otherwise(_let(windows, covered)).cast("long")


def measure(docs: DataFrame, keep: list[str]) -> DataFrame:
    """row (the kept columns), lang, source, the counts of the contract and the metrics."""
    words = F.filter(F.split(F.col("text"), _SPACE), lambda w: w != "")
    lines = F.filter(F.split(F.col("text"), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    def count(kind: str) -> Column:
        return F.length(F.regexp_replace("text", f"[^{kind}]+", "")).cast("long")

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col("lang"), F.col("source"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    split = rows.select("row", "lang", "source", words.alias("words"), lines.alias("lines"), count(r"#*$%&|<>").alias("n_symbols"), count("A-Z").alias("n_upper"))
    counted = split.select(
        "row", "lang", "source", F.size("words").cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"), "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), _repeated(F.col("words")).alias("n_repeat_words"), F.size("lines").cast("long").alias("n_lines"), "n_upper",
    )

    def per(top: str, bottom: str, unit: int) -> Column:
        return F.coalesce(F.expr(f"{unit} * {top} div nullif({bottom}, 0)"), F.lit(0).cast("long"))

    return counted.withColumns({
        "symbol_pm": per("n_symbols", "n_words", 1000), "word_length_pc": per("word_chars", "n_words", 100), "dup_line_pm": per("n_dup_lines", "n_lines", 1000),
        "repeat_pm": per("n_repeat_words", "n_words", 1000), "upper_pm": per("n_upper", "word_chars", 1000),
        "base_failed": (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
    })


def _bucket(value: Column) -> Column:
    """The least value with the same STEP_BITS leading bits."""
    drop = F.greatest(F.length(F.bin(value)) - STEP_BITS, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, drop), drop)


def thresholds(measured: DataFrame) -> DataFrame:
    """(level, lang, source, n, {metric}_low, {metric}_high): level 0 for a group, 1 for a language, 2 for the corpus."""
    metric = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), _bucket(F.col(m)).alias("bucket")) for m in SLACK])).alias("m")
    sketch = measured.where(~F.col("base_failed")).select("lang", "source", metric).groupBy("lang", "source", "m.metric", "m.bucket").agg(F.count(F.lit(1)).alias("n"))
    levels = F.explode(F.array(*[F.struct(F.lit(k).alias("level"), (F.col("lang") if k < 2 else F.lit(None).cast("string")).alias("lang"), (F.col("source") if k < 1 else F.lit(None).cast("string")).alias("source")) for k in range(3)])).alias("at")
    merged = sketch.select(levels, "metric", "bucket", "n").groupBy("at", "metric", "bucket").agg(F.sum("n").alias("n"))
    group = Window.partitionBy("at", "metric")
    run = merged.select("at", "metric", "bucket", F.sum("n").over(group.orderBy("bucket")).alias("upto"), F.sum("n").over(group).alias("n"))
    quart = run.groupBy("at", "metric").agg(F.max("n").alias("n"), F.min(F.when(4 * F.col("upto") >= F.col("n"), F.col("bucket"))).alias("q1"), F.min(F.when(4 * F.col("upto") >= 3 * F.col("n"), F.col("bucket"))).alias("q3"))
    slack = F.create_map(*[F.lit(x) for m in SLACK.items() for x in m])
    reach = FENCE * F.greatest(F.col("q3") - F.col("q1"), slack[F.col("metric")].cast("long"))
    fences = quart.select("at", "metric", "n", (F.col("q1") - reach).alias("low"), (F.col("q3") + reach).alias("high"))
    wide = fences.groupBy("at").agg(F.max("n").alias("n"), *[F.max(F.when(F.col("metric") == m, F.col(e))).alias(f"{m}_{e}") for m in SLACK for e in ("low", "high")])
    return wide.select("at.level", "at.lang", "at.source", "n", *[f"{m}_{e}" for m in SLACK for e in ("low", "high")])


def judge(measured: DataFrame, fences: DataFrame) -> DataFrame:
    """measured with kept."""
    names = [f"{m}_{e}" for m in SLACK for e in ("low", "high")]

    def level(k: int) -> DataFrame:
        own = fences.where((F.col("level") == k) & ((F.col("n") >= MIN_ROWS) | F.lit(k == 2)))
        return own.select(F.col("lang").alias(f"lang{k}"), F.col("source").alias(f"source{k}"), F.struct(*names).alias(f"fence{k}"))

    joined = measured.join(broadcast_if_small(level(0)), F.col("lang").eqNullSafe(F.col("lang0")) & F.col("source").eqNullSafe(F.col("source0")), "left")
    joined = joined.join(broadcast_if_small(level(1)), F.col("lang").eqNullSafe(F.col("lang1")), "left")
    whole = level(2).first()  # one row
    for name, at in ((n, f"f_{n}") for n in names):
        last = F.lit(whole["fence2"][name] if whole else None).cast("long")
        joined = joined.withColumn(at, F.coalesce(F.col(f"fence0.{name}"), F.col(f"fence1.{name}"), last))
    bad = F.lit(False)
    for m in SLACK:
        bad = bad | F.coalesce(F.col(m) > F.col(f"f_{m}_high"), F.lit(False))
        if m in BOTH_SIDES:
            bad = bad | F.coalesce(F.col(m) < F.col(f"f_{m}_low"), F.lit(False))
    return joined.select(*measured.columns, (~F.col("base_failed") & ~bad).alias("kept"))


def apply_rules(docs: DataFrame, keep: list[str]) -> DataFrame:
    measured = stage(measure(docs, keep), "measured")
    return judge(measured, stage(thresholds(measured), "thresholds"))


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return apply_rules(docs, ["doc_id"]).select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def keep_good(docs: DataFrame) -> DataFrame:
    """Pipeline stage: documents that fail a rule go."""
    return apply_rules(docs, docs.columns).where("kept").select("row.*")


#: DuckDB SQL for the rows of query().
ORACLE_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
s AS (
  SELECT r, doc_id, lang, source, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines,
         length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, length(regexp_replace(t, '[^A-Z]+', '', 'g'))::BIGINT AS n_upper FROM d),
w AS (SELECT r, unnest(range(1, len(words) - 1)) AS i, words FROM s WHERE len(words) > 2),
g AS (SELECT r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g FROM w),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT p)::BIGINT AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY r),
c AS (
  SELECT s.*, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         len(lines)::BIGINT AS n_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words FROM s LEFT JOIN rep USING (r)),
m AS (
  SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed, [
    {'m': 'symbol_pm', 'v': coalesce(1000 * n_symbols // nullif(n_words, 0), 0), 'slack': 25}, {'m': 'word_length_pc', 'v': coalesce(100 * word_chars // nullif(n_words, 0), 0), 'slack': 20},
    {'m': 'dup_line_pm', 'v': coalesce(1000 * n_dup_lines // nullif(n_lines, 0), 0), 'slack': 60}, {'m': 'repeat_pm', 'v': coalesce(1000 * n_repeat_words // nullif(n_words, 0), 0), 'slack': 60},
    {'m': 'upper_pm', 'v': coalesce(1000 * n_upper // nullif(word_chars, 0), 0), 'slack': 50}] AS ms FROM c),
v AS (SELECT r, lang, source, base_failed, x.m AS m, x.v AS v, x.slack AS slack FROM (SELECT r, lang, source, base_failed, unnest(ms) AS x FROM m)),
b AS (SELECT *, (v >> greatest(length(bin(v)) - 6, 0)) << greatest(length(bin(v)) - 6, 0) AS k FROM v),
l AS (
  SELECT 0 AS level, lang, source, m, slack, k FROM b WHERE NOT base_failed UNION ALL
  SELECT 1, lang, NULL, m, slack, k FROM b WHERE NOT base_failed UNION ALL SELECT 2, NULL, NULL, m, slack, k FROM b WHERE NOT base_failed),
h AS (SELECT level, lang, source, m, slack, k, count(*) AS n FROM l GROUP BY ALL),
q AS (SELECT *, sum(n) OVER (PARTITION BY level, lang, source, m ORDER BY k) AS upto, sum(n) OVER (PARTITION BY level, lang, source, m) AS total FROM h),
f AS (
  SELECT level, lang, source, m, max(total) AS n, min(k) FILTER (4 * upto >= total) AS q1, min(k) FILTER (4 * upto >= 3 * total) AS q3, max(slack) AS slack FROM q GROUP BY ALL),
e AS (SELECT *, q1 - 8 * greatest(q3 - q1, slack) AS low, q3 + 8 * greatest(q3 - q1, slack) AS high FROM f WHERE level = 2 OR n >= 100),
j AS (
  SELECT v.r, bool_or(coalesce(v.v > coalesce(e0.high, e1.high, e2.high), false) OR (v.m = 'word_length_pc' AND coalesce(v.v < coalesce(e0.low, e1.low, e2.low), false))) AS bad
  FROM v LEFT JOIN e e0 ON e0.level = 0 AND e0.m = v.m AND e0.lang IS NOT DISTINCT FROM v.lang AND e0.source IS NOT DISTINCT FROM v.source
  LEFT JOIN e e1 ON e1.level = 1 AND e1.m = v.m AND e1.lang IS NOT DISTINCT FROM v.lang LEFT JOIN e e2 ON e2.level = 2 AND e2.m = v.m GROUP BY v.r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND NOT bad) AS kept FROM m JOIN j USING (r)
"""
