"""Scores: capped deductions per dimension, weighted to a total in hundredths.

Array form: a document's findings are grouped by array functions over the fixed
42 rules, so scoring needs no shuffle either. A score is partial: the rules left
to a human judge (constants.JUDGE_ONLY) are not in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.text import band
from .audit import axis, message



def hits(rule: str) -> Column:
    return F.size(F.filter("findings", lambda f: f["rule"] == rule))


def dimension(name: str) -> Column:
    return F.greatest(F.lit(0), F.lit(100) - sum(F.least(hits(r) * per, F.lit(cap)) for r, d, per, cap, _ in C.RULES if d == name))


def scored(audited: DataFrame) -> DataFrame:
    """audited plus a column per dimension (0 to 100), x_deduct, total_hundredths
    (exact; round for display only), band and n_findings."""
    x = F.least(F.lit(C.GLOBAL_CAP), sum(F.when(hits(r) > 0, points).otherwise(0) for r, points in C.GLOBAL_RULES.items()))
    rows = audited.withColumns({n: dimension(n).cast("int") for n in C.DIMENSIONS} | {"x_deduct": x.cast("int")})
    total = sum(F.col(n) * w for n, w in C.DIMENSIONS.items()) - 100 * F.col("x_deduct")
    rows = rows.withColumn("total_hundredths", F.least(F.greatest(total, F.lit(0)), F.lit(10000)).cast("long"))
    return rows.withColumns({"band": band(F.col("total_hundredths")), "n_findings": F.size("findings").cast("long")})


def score(audited: DataFrame, *keep: str) -> DataFrame:
    """doc_id, the columns of scored() and those to keep."""
    return scored(audited).select("doc_id", *C.DIMENSIONS, "x_deduct", "total_hundredths", "band", "n_findings", *keep)


def dim_scores(scores: DataFrame) -> DataFrame:
    """Long form: doc_id, dim, weight, score."""
    made = F.array(*[F.struct(F.lit(n).alias("dim"), F.lit(w).alias("weight"), F.col(n).alias("score")) for n, w in C.DIMENSIONS.items()])
    return scores.select("doc_id", F.inline_outer(made))


def gate(scores: DataFrame, min_score: float) -> DataFrame:
    """One row: the worst total and whether the corpus passes."""
    worst = F.min("total_hundredths")
    return scores.agg(worst.alias("worst_hundredths"), (F.coalesce(worst, F.lit(10000)) >= round(min_score * 100)).alias("passes"))


def as_json(audited: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and a JSON object: path (a column's name), lang, lines, the score
    with its dimensions, global rules hit and rules left unscored, and all findings."""
    x_hits = F.filter(F.array(*[F.when(hits(r) > 0, F.lit(r)) for r in C.GLOBAL_RULES]), lambda r: r.isNotNull())
    dims = F.struct(*[F.struct(F.lit(w).alias("weight"), F.col(n).alias("score")).alias(n) for n, w in C.DIMENSIONS.items()])
    total = F.struct((F.col("total_hundredths") / 100).alias("total"), "band", dims.alias("dims"), "x_deduct", x_hits.alias("x_hits"), F.array(*map(F.lit, C.JUDGE_ONLY)).alias("unscored"), F.lit(True).alias("det_only"))
    found = F.transform("findings", lambda f: F.struct(f["rule"].alias("rule"), f["line"].alias("line"), message(f["rule"]).alias("msg"), axis(f["rule"]).alias("axis"), f["rule"].isin(*C.ADVISORY).alias("advisory")))
    whole = F.struct((F.col(path) if path else F.lit("")).alias("path"), "lang", F.col("n_lines").alias("lines"), total.alias("score"), found.alias("findings"))
    return scored(audited).select("doc_id", F.to_json(whole).alias("json"))


def top_rules(findings: DataFrame, per_rule: int = 3) -> DataFrame:
    """doc_id, rule, hits and the first lines of each rule."""
    grouped = findings.groupBy("doc_id", "rule").agg(F.count(F.lit(1)).alias("hits"), F.array_sort(F.collect_list("line")).alias("all"))
    return grouped.select("doc_id", "rule", "hits", F.slice("all", 1, per_rule).alias("first_lines"))


def markdown(scores: DataFrame, findings: DataFrame) -> DataFrame:
    """doc_id and a Markdown report: dimension table, then rules by count."""
    lines = top_rules(findings)
    text = F.concat(F.lit("- "), "rule", F.lit(" x"), F.col("hits").cast("string"), F.lit(" at L"), F.array_join(F.col("first_lines").cast("array<string>"), ", L"), F.when(F.col("hits") > 3, F.concat(F.lit(" and "), (F.col("hits") - 3).cast("string"), F.lit(" more"))).otherwise(""))
    listed = lines.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("hits")).alias("k"), "rule", text.alias("t")))), lambda x: x["t"]), "\n").alias("rules"))
    table = F.concat(*[F.concat(F.lit(f"| {n} | {w} | "), F.col(n).cast("string"), F.lit(" |\n")) for n, w in C.DIMENSIONS.items()])
    head = F.concat(F.lit("# Partial score "), F.format_number(F.col("total_hundredths") / 100, 2), F.lit(" ("), "band", F.lit(")\n\n| dimension | weight | score |\n|---|---|---|\n"), table, F.lit("\nX: -"), F.col("x_deduct").cast("string"), F.lit("\n\n"))
    return scores.join(listed, "doc_id", "left").select("doc_id", F.concat(head, F.coalesce("rules", F.lit("no findings")), F.lit("\n\nLeft to a judge: " + " ".join(C.JUDGE_ONLY) + "\n")).alias("report"))
