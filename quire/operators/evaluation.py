"""Measures of answered cases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def refusal_metrics(cases: DataFrame) -> DataFrame:
    """One row of cases(answerable, found): how many unanswerable ones were refused, and answerable ones too; a rate without cases is null."""
    asked = {"unanswerable": ~F.col("answerable"), "answerable": F.col("answerable")}
    refused = {"correct_refusals": ~F.col("answerable") & ~F.col("found"), "false_refusals": F.col("answerable") & ~F.col("found")}
    rate = lambda a, b: F.round(F.try_divide(F.count_if(a), F.count_if(b)), 3)
    return cases.agg(
        rate(refused["correct_refusals"], asked["unanswerable"]).alias("refusal_recall"), rate(refused["false_refusals"], asked["answerable"]).alias("false_refusal_rate"),
        *[F.count_if(c).alias(n) for n, c in {**asked, **refused}.items()],
    )


def page_hits(cases: DataFrame) -> DataFrame:
    """One row of cases(expected array<int>, cited array<int>, found): of the answered ones that expect pages, how many there are and the share that cites any of them."""
    own = cases.where((F.size("expected") > 0) & F.col("found"))
    return own.agg(F.count(F.lit(1)).alias("cases"), F.round(F.try_divide(F.count_if(F.arrays_overlap("expected", "cited")), F.count(F.lit(1))), 3).alias("page_hit_rate"))


def per_case(cases: DataFrame, answers: DataFrame) -> DataFrame:
    """cases(question, text, answerable, expected array<int>) with what operators.asking.ask answered: found, answer, cited pages and rewrites."""
    pages = F.array_sort(F.array_distinct(F.flatten(F.transform("citations", lambda c: F.sequence(c["page_start"], c["page_end"])))))
    told = answers.select("question", "found", F.substring("answer", 1, 500).alias("answer"), pages.alias("cited"), "rewrites")
    return cases.join(told, "question").withColumn("expected", F.coalesce("expected", F.array().cast("array<int>")))


def report(rows: DataFrame) -> DataFrame:
    """One row of per_case rows: how many cases there are, the mean of rewrites, refusals and page hits."""
    told = rows.agg(F.count(F.lit(1)).alias("case_count"), F.round(F.avg("rewrites"), 2).alias("avg_rewrites"))
    return told.join(refusal_metrics(rows), how="cross").join(page_hits(rows), how="cross")  # a row each
