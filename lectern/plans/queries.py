"""The driver's queries for the readability engine, each with SQL that states
the result independently."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import text as T
from ..operators.audit import audit, findings
from ..operators.parse import exploded_blocks, parse
from ..operators.report import report
from ..operators.rewrite import check_gate, fmt
from ..operators.score import as_json, dim_scores, gate, score, top_rules
from ..operators.verify import verify
from ..sources.documents import read_table, skeletons
from . import corpus

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/documents.parquet").select("doc_id", "raw")


def made(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A corpus SELECT over the customer table; no view is left behind."""
    rows = spark.sql(sql.replace("FROM customer", "FROM {customer}"), customer=spark.read.parquet(f"{sf_dir}/customer.parquet"))
    # the table is one small file: dealt out, all cores audit, and the text is made once
    return rows.repartition(spark.sparkContext.defaultParallelism, rows.columns[0])


def md(spark: SparkSession, sf_dir: str) -> DataFrame:
    return made(spark, sf_dir, corpus.md_corpus())


# -- sources and text -------------------------------------------------------------

LINES = "CASE WHEN text = '' THEN 0 ELSE len(string_split(text, chr(10))) - CASE WHEN suffix(text, chr(10)) THEN 1 ELSE 0 END END"


@query(f"SELECT doc_id, ({LINES})::INTEGER AS n_lines FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)")
def lines_per_doc(spark, sf_dir):
    raw = F.coalesce("raw", F.lit(""))
    n = F.size(F.split(raw, "\n")) - F.endswith(raw, F.lit("\n")).cast("int")
    return docs(spark, sf_dir).select("doc_id", F.when(raw == "", 0).otherwise(n).alias("n_lines"))


CJK_CLASS = r"[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}\x{3040}-\x{30ff}]"


@query(rf"SELECT item_id, len(regexp_extract_all(text, '{CJK_CLASS}'))::INTEGER AS n_cjk, len(regexp_extract_all(text, '[A-Za-z][A-Za-z''’-]*'))::INTEGER AS n_words FROM benchmark")
def unit_counts(spark, sf_dir):
    text = F.col("text")
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", T.cjk_chars(text).alias("n_cjk"), T.latin_words(text).alias("n_words"))


STRIP = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '!?\\[([^\\]]*)\\]\\(([^)\\s]*)[^)]*\\)', '\\1', 'g'), '`+[^`\\n]*?`+', ' ', 'g'), '</?[A-Za-z][^>]*>', '', 'g'), '[*_~]{1,3}', '', 'g')"


@query(f"SELECT doc_id, {STRIP} AS plain FROM documents")
def strip_inline(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.strip_inline(F.col("raw")).alias("plain"))


@query(f"SELECT doc_id, 'en' AS lang, len(regexp_extract_all({STRIP}, '[A-Za-z][A-Za-z''’-]*'))::INTEGER AS n_words FROM documents")
def doc_language(spark, sf_dir):
    plain = T.strip_inline(F.col("raw"))
    share = T.cjk_chars(plain) / F.greatest(T.cjk_chars(plain) + T.latin_words(plain), F.lit(1))
    return docs(spark, sf_dir).select("doc_id", F.when(share > 0.30, "zh").otherwise("en").alias("lang"), T.latin_words(plain).alias("n_words"))


SENTENCES = f"""
SELECT doc_id, unnest(list_filter(list_transform(string_split(regexp_replace(regexp_replace(plain, '([.!?;])\\s+([A-Z"''(\\[])', '\\1' || chr(1) || '\\2', 'g'), '\\n([-*#])', chr(1) || '\\1', 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '')) AS s
FROM (SELECT doc_id, trim(regexp_replace({STRIP}, '\\n+', ' ', 'g')) AS plain FROM documents)
"""


@query(f"SELECT doc_id, count(*) AS n_sentences, max(len(regexp_extract_all(s, '[A-Za-z][A-Za-z''’-]*')))::INTEGER AS longest FROM ({SENTENCES}) GROUP BY doc_id")
def sentence_stats(spark, sf_dir):
    flat = T.sub(T.strip_inline(F.col("raw")), "\n+", " ")
    s = T.sentences(flat, F.lit("en"))
    rows = docs(spark, sf_dir).select("doc_id", F.transform(s, T.latin_words).alias("n"))
    # outer: a filter on n would be pushed below it, and split every text twice
    found = F.when(F.size("n") > 0, F.array(F.struct(F.size("n").cast("long").alias("n_sentences"), F.array_max("n").alias("longest"))))
    return rows.select("doc_id", F.inline_outer(found)).where(F.col("n_sentences").isNotNull())


# -- parsing ------------------------------------------------------------------------


_KINDS = ", ".join(f"({i}, {n}, '{kind}')" for i in range(len(corpus.DEFECTS)) for n, kind in enumerate(corpus.kinds(i)))


@query(f"SELECT c_custkey AS doc_id, block_no, kind FROM customer JOIN (VALUES {_KINDS}) AS v(k, block_no, kind) ON c_custkey % {len(corpus.DEFECTS)} = k")
def blocks(spark, sf_dir):
    return exploded_blocks(md(spark, sf_dir)).select("doc_id", "block_no", "kind")


@query(f"SELECT c_custkey AS doc_id, CAST({corpus.case([str(corpus.kinds(i).count('heading')) for i in range(len(corpus.DEFECTS))])} AS BIGINT) AS n_headings FROM customer")
def headings(spark, sf_dir):
    return parse(md(spark, sf_dir)).select("doc_id", F.size(F.filter("blocks", lambda b: b["kind"] == "heading")).cast("long").alias("n_headings"))


@query(f"SELECT doc_id, {STRIP} AS plain FROM (SELECT doc_id, raw AS text FROM ({corpus.md_corpus()}))")
def md_strip_inline(spark, sf_dir):
    return md(spark, sf_dir).select("doc_id", T.strip_inline(F.col("raw")).alias("plain"))


# -- audit and scores -----------------------------------------------------------------


@query(corpus.expected_findings())
def md_findings(spark, sf_dir):
    return findings(audit(md(spark, sf_dir))).groupBy("doc_id", "rule").agg(F.count(F.lit(1)).alias("hits"))


def _expected_dims() -> list[dict]:
    per = {r: (d, p, cap) for r, d, p, cap, _ in C.RULES}
    out = []
    for _, found in corpus.DEFECTS:
        dims = dict.fromkeys(C.DIMENSIONS, 100)
        for r, n in found.items():
            if r in per:
                d, p, cap = per[r]
                dims[d] -= min(p * n, cap)
        out.append(dims)
    return out


_DIMS = _expected_dims()
_X = [min(C.GLOBAL_CAP, sum(C.GLOBAL_RULES.get(r, 0) for r in found)) for _, found in corpus.DEFECTS]
_TOTALS = f"SELECT c_custkey AS doc_id, CAST({corpus.case(list(map(str, corpus.TOTALS)))} AS BIGINT) AS total_hundredths, {corpus.case(list(map(str, _X)))} AS x_deduct FROM customer"


@query(_TOTALS)
def md_scores(spark, sf_dir):
    return score(audit(md(spark, sf_dir))).select("doc_id", "total_hundredths", "x_deduct")


@query(" UNION ALL ".join(f"SELECT c_custkey AS doc_id, '{d}' AS dim, {w} AS weight, {corpus.case([str(s[d]) for s in _DIMS])} AS score FROM customer" for d, w in C.DIMENSIONS.items()))
def md_dim_scores(spark, sf_dir):
    return dim_scores(score(audit(md(spark, sf_dir))))


@query(f"SELECT min(total_hundredths) AS worst_hundredths, min(total_hundredths) >= 9000 AS passes FROM ({_TOTALS})")
def corpus_gate(spark, sf_dir):
    return gate(score(audit(md(spark, sf_dir))), 90)


@query(f"SELECT doc_id, rule, hits, least(hits, 3)::INTEGER AS n_shown FROM ({corpus.expected_findings()})")
def md_top_rules(spark, sf_dir):
    return top_rules(findings(audit(md(spark, sf_dir)))).select("doc_id", "rule", "hits", F.size("first_lines").alias("n_shown"))


@query(f"SELECT c_custkey AS doc_id, {corpus.case([repr('zh' if t.startswith('zh:') else 'en') for t, _ in corpus.DEFECTS])} AS lang FROM customer")
def md_language(spark, sf_dir):
    return audit(md(spark, sf_dir)).select("doc_id", "lang")


@query(corpus.expected_findings(links=True))
def md_link_findings(spark, sf_dir):
    """The two link rules, which strict_compat leaves out."""
    return findings(audit(made(spark, sf_dir, corpus.md_links()), strict_compat=False)).groupBy("doc_id", "rule").agg(F.count(F.lit(1)).alias("hits"))


@query(f"SELECT doc_id, (json->>'$.score.total')::DOUBLE AS total, (json->>'$.lang') AS lang, json_array_length(json, '$.findings')::INTEGER AS n_findings FROM (SELECT doc_id, json_object('score', json_object('total', total_hundredths / 100), 'lang', lang, 'findings', [x FOR x IN range(n)]) AS json FROM (SELECT c_custkey AS doc_id, {corpus.case(list(map(str, corpus.TOTALS)))} AS total_hundredths, {corpus.case([repr('zh' if t.startswith('zh:') else 'en') for t, _ in corpus.DEFECTS])} AS lang, {corpus.case([str(sum(f.values())) for _, f in corpus.DEFECTS])} AS n FROM customer))")
def md_json(spark, sf_dir):
    found = as_json(audit(md(spark, sf_dir)))
    return found.select("doc_id", F.get_json_object("json", "$.score.total").cast("double").alias("total"), F.get_json_object("json", "$.lang").alias("lang"), F.size(F.from_json(F.get_json_object("json", "$.findings"), "array<struct<rule:string>>")).alias("n_findings"))


@query()
def doc_findings(spark, sf_dir):
    return findings(audit(docs(spark, sf_dir))).groupBy("doc_id", "rule").agg(F.count(F.lit(1)).alias("hits"))


# -- rewriting and verifying --------------------------------------------------------------


@query(corpus.formatted())
def md_formatted(spark, sf_dir):
    return fmt(md(spark, sf_dir)).select("doc_id", "formatted")


@query(f"SELECT count(*) AS n_changed, count(*) = 0 AS passes FROM ({corpus.md_corpus()}) m JOIN ({corpus.formatted()}) f USING (doc_id) WHERE raw <> formatted")
def fmt_check(spark, sf_dir):
    return check_gate(fmt(md(spark, sf_dir)))


@query(corpus.expected_verdicts())
def verify_format(spark, sf_dir):
    found = verify(made(spark, sf_dir, corpus.md_pairs()))
    return found.select("pair_id", "ok", F.array_join(F.transform("issues", lambda x: x["kind"]), ",").alias("kinds"))


@query(corpus.expected_verdicts(content=True))
def verify_content(spark, sf_dir):
    found = verify(made(spark, sf_dir, corpus.md_pairs()), "content")
    return found.select("pair_id", "ok", F.array_join(F.transform("issues", lambda x: x["kind"]), ",").alias("kinds"))


def _report_sql() -> str:
    """Formatting mends what corpus.MENDED lists, and loses nothing; at the level
    that a report has by default, C5 isn't asked for."""
    best = {i for i, (_, found) in enumerate(corpus.DEFECTS) if i in corpus.MENDED}
    unasked = {i for i, (_, found) in enumerate(corpus.DEFECTS) if "C5" in found}
    old = [10000 if i in unasked else t for i, t in enumerate(corpus.TOTALS)]
    new = [10000 if i in best else t for i, t in enumerate(old)]
    passes = [str(not x).lower() for x in _X]
    delta = {d: [100 - dims[d] if i in best else 0 for i, dims in enumerate(_DIMS)] for d in C.DIMENSIONS}
    columns = [f"{corpus.case(list(map(str, delta[d])))} AS {d}_delta" for d in C.DIMENSIONS]
    big = lambda values, name: f"CAST({corpus.case(list(map(str, values)))} AS BIGINT) AS {name}"
    return f"SELECT c_custkey AS pair_id, {big(old, 'old_total_hundredths')}, {big(new, 'new_total_hundredths')}, {corpus.case(list(map(str, _X)))} AS new_x_deduct, {', '.join(columns)}, true AS ok, {corpus.case(passes)} AS passes FROM customer"


@query(_report_sql())
def report_delta(spark, sf_dir):
    pairs = made(spark, sf_dir, f"SELECT a.doc_id AS pair_id, a.raw AS old, b.formatted AS new FROM ({corpus.md_corpus()}) a JOIN ({corpus.formatted()}) b ON a.doc_id = b.doc_id")
    return report(pairs).select("pair_id", "old_total_hundredths", "new_total_hundredths", "new_x_deduct", *[f"{d}_delta" for d in C.DIMENSIONS], "ok", "passes")


@query("SELECT * FROM (VALUES ('readme', 3), ('tutorial', 3), ('reference', 3), ('adr', 3), ('runbook', 3), ('notes', 3)) AS v(type, sections)")
def skeleton_types(spark, sf_dir):
    parts = F.size(F.split("body", "(?m)^## ")) - 1
    return skeletons(spark).select("type", parts.alias("sections"))
