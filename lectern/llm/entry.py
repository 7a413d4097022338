"""The driver's queries for these operators, and SQL for those that SQL can
express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, cover_tree, exact_dedup, html_blocks, mixing, sentencepiece_scan, sharding, simhash, toxicity, url_filter

RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
SHARDS = 24
WEIGHTS = (5, 2, 1)
#: The public vocabulary file that op2 and the pipeline encode by.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def source_weights(sources: list) -> list[int]:
    return [WEIGHTS[i % len(WEIGHTS)] for i in range(len(sources))]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), RULES).select("page_id", "host", "path", "rule", "verdict")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = sentencepiece_scan.decode(sentencepiece_scan.encode(table(spark, sf_dir, "documents"), MODEL), MODEL)
    return both.select("doc_id", "n_chars", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.near_vectors(table(spark, sf_dir, "embeddings"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_blocks.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"), out="text")
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", toxicity.is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"), F.size("sentences").alias("n_sentences"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    done = chat.format_chats(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra))
    turns, loss = chat.read_turns(F.col("formatted")), chat.read_loss(F.col("formatted"), F.col("spans"))
    read = done.select("conv_id", "formatted", turns.alias("turns"), loss.alias("loss"))
    digest = F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256)
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), digest.alias("turns_sha256"), F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (F.octet_length(raw) + 8).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    placed = sharding.shard(docs, [1.0] * SHARDS, [1.0] * (SHARDS + 1))
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    mixed, report = mixing.mix(docs, F.array("source"), source_weights)
    known = spark.createDataFrame([(s, x["size"], x["target"]) for s, x in report.items()], "s string, source_size bigint, target double")
    out = mixed.select("doc_id", "size", "source", "taken")
    # one row a source: mix() has just planned for them, so mixing.PATTERNS at most
    return out.join(F.broadcast(known), out["source"].eqNullSafe(known["s"])).select("doc_id", "size", "source_size", "target", "taken")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), keep="largest")
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name[:2] == "op" and name[2].isdigit()}


def _op1_sql() -> str:
    """The rules and both Markov models, in SQL."""
    case_rule, case_verdict = [], []
    for what, rule in sorted(RULES, key=lambda r: -len(r[1])):
        host, _, path = rule.partition("/")
        fits = f"(host = '{host}' OR suffix(host, '.{host}')) AND starts_with(path, '/{path}')"
        case_rule.append(f"WHEN {fits} THEN '{rule}'")
        case_verdict.append(f"WHEN {fits} THEN '{what}'")
    k = url_filter.ORDER
    held = "substr(md5(u), 1, 1) IN ('0', '1')"
    models = []
    for o in range(k + 1):
        context = f"PARTITION BY substr(g, 1, {o})" if o else ""
        seen = lambda c: f"sum({c}) OVER ({context}) AS t{c}, sum(CASE WHEN {c} > 0 THEN 1 ELSE 0 END) OVER ({context}) AS d{c}"
        p = lambda c: f"CASE WHEN t{c} + d{c} > 0 THEN ({c} + d{c} * {f'b.p{c}' if o else '1.0 / 256'}) / (t{c} + d{c}) ELSE {f'b.p{c}' if o else '1.0 / 256'} END AS p{c}"
        models.append(f"g{o} AS (SELECT *, {seen('a')}, {seen('r')} FROM (SELECT substr(gram, {k + 1 - o}) AS g, sum(a)::DOUBLE AS a, sum(r)::DOUBLE AS r FROM grams GROUP BY 1))")
        models.append(f"m{o} AS (SELECT g{o}.g, {p('a')}, {p('r')} FROM g{o}" + (f" JOIN m{o - 1} b ON b.g = substr(g{o}.g, 2))" if o else ")"))
    return f"""
WITH split AS (SELECT page_id, CASE WHEN url IS NULL OR NOT contains(url, '://') THEN '' ELSE substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
named AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM split),
ruled AS (SELECT *, host || path AS u, CASE {' '.join(case_rule)} END AS rule, CASE {' '.join(case_verdict)} END AS v FROM named),
urls AS (SELECT u, v, CASE WHEN v = 'allow' AND NOT {held} THEN count(*) ELSE 0 END AS a, CASE WHEN v = 'block' AND NOT {held} THEN count(*) ELSE 0 END AS r FROM ruled GROUP BY u, v),
padded AS (SELECT *, repeat(chr(2), {k}) || u || chr(3) AS s FROM urls),
spots AS (SELECT u, v, a, r, substr(s, i, {k + 1}) AS gram FROM (SELECT *, unnest(range(1, length(s) - {k} + 1)) AS i FROM padded)),
grams AS (SELECT gram, sum(a) AS a, sum(r) AS r FROM spots GROUP BY gram),
{','.join(models)},
scored AS (SELECT u, v, avg(ln(pa) - ln(pr)) AS score FROM spots JOIN m{k} ON g = gram GROUP BY u, v),
fit AS (SELECT avg(score) FILTER (v = 'allow') AS ma, avg(score) FILTER (v = 'block') AS mr, stddev_pop(score) FILTER (v = 'allow') AS sa, stddev_pop(score) FILTER (v = 'block') AS sr FROM scored WHERE {held}),
line AS (SELECT CASE WHEN ma IS NULL OR mr IS NULL THEN 0 WHEN sa + sr > 0 THEN (ma * sr + mr * sa) / (sa + sr) ELSE (ma + mr) / 2 END AS x FROM fit)
SELECT page_id, host, path, rule, coalesce(r.v, CASE WHEN score >= (SELECT x FROM line) THEN 'allow' ELSE 'block' END) AS verdict
FROM ruled r LEFT JOIN (SELECT u, score FROM scored WHERE v IS NULL) s ON r.v IS NULL AND r.u = s.u
"""


_OP3_SQL = """
WITH RECURSIVE ok AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
u AS (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM ok),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND list_dot_product(a.v, b.v) >= 0.95),
walk(a, b) AS (SELECT a, b FROM links UNION SELECT w.a, l.b FROM walk w JOIN links l ON w.b = l.a)
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links,
       least(vec_id, coalesce((SELECT min(b) FROM walk WHERE a = vec_id), vec_id)) AS component_id,
       vec_id = least(vec_id, coalesce((SELECT min(b) FROM walk WHERE a = vec_id), vec_id)) AS kept
FROM embeddings
"""

#: For pages like those of the given table, whose article is the only one and ends
#: its blocks by tags: what stands between its tags.
_OP4_SQL = r"""
WITH inside AS (SELECT page_id, url, regexp_replace(regexp_replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1), '</?b>', '', 'g'), '<br>', ' ', 'g') AS t FROM pages),
parts AS (SELECT page_id, url, string_split(regexp_replace(regexp_replace(t, '\s+', ' ', 'g'), '(<[^>]+>)+', chr(10), 'g'), chr(10)) AS lines FROM inside),
plain AS (SELECT page_id, url, list_transform(lines, lambda x: trim(regexp_replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;?', '&', 'g'))) AS lines FROM parts)
SELECT page_id, url, array_to_string(list_filter(lines, lambda x: x <> ''), chr(10)) AS text, length(array_to_string(list_filter(lines, lambda x: x <> ''), chr(10))) AS n_chars FROM plain
"""

_OP7_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, replace(replace(replace(replace(text, '\', '\b'), '<turn>', '\lturn>'), '<text>', '\ltext>'), '</turn>', '\l/turn>') AS safe,
             coalesce(role <> lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text), true) AS begins FROM t)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length(safe) + 6 + CASE WHEN begins THEN 6 + length(role) + 8 ELSE 0 END)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


def _op8_sql() -> str:
    """CRC-32 by nibbles (its 16-entry table made by the polynomial's rule)."""
    crc_table = []
    for i in range(16):
        for _ in range(4):
            i = i >> 1 ^ (0xEDB88320 if i & 1 else 0)
        crc_table.append(i)
    score = lambda n: f"list_max(list_transform(range(0, {n}), lambda i: {{'s': substr(md5(k || ':' || i), 1, 13), 'i': -i}})).i"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(doc_id::VARCHAR, '') AS k FROM documents),
nibbles AS (SELECT *, list_transform(string_split(hex(encode(text)), ''), lambda c: strpos('0123456789ABCDEF', c) - 1) AS h FROM d),
low_first AS (SELECT *, list_transform(range(1, len(h) + 1), lambda i: h[CASE WHEN i % 2 = 1 THEN i + 1 ELSE i - 1 END]) AS x FROM nibbles),
summed AS (SELECT *, CASE WHEN text = '' THEN 0 ELSE xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(x, lambda c: c::BIGINT)), lambda crc, c: xor(crc >> 4, ({crc_table}::BIGINT[])[xor(crc, c) % 16 + 1])), 4294967295::BIGINT) END AS crc FROM low_first),
placed AS (SELECT *, (-{score(SHARDS)})::INTEGER AS shard, (-{score(SHARDS + 1)})::INTEGER AS grown_shard FROM summed)
SELECT doc_id, (strlen(text) + 8)::BIGINT AS size, crc::BIGINT AS text_crc32, 'key' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY md5(k || '|' || crc), k, md5(text)) - 1 AS slot, grown_shard
FROM placed
"""


_OP10_SQL = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM t WINDOW w AS (PARTITION BY t)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filter": _op1_sql(), "op3_embedding_dedup": _OP3_SQL, "op4_html_text": _OP4_SQL, "op7_chat_format": _OP7_SQL, "op8_sharding": _op8_sql(), "op10_exact_dedup": _OP10_SQL}
