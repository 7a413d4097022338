import hashlib

from pyspark.sql import functions as F

from lectern.llm.common import attach
from lectern.llm.exact_dedup import exact_dedup

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ROWS = [(1, "Abc"), (2, "aBC"), (3, "abc "), (4, None), (5, ""), (6, "É"), (7, "é"), (8, "x" * 70_000), (9, "X" * 70_000), (None, "abc"), (10, "Q"), (10, "Q"), (10, "other")]


def brute(rows, best):
    groups = {}
    for i, t in rows:
        groups.setdefault((t or "").translate(UP), []).append(i)
    return sorted((str(i), str(best([x for x in g if x is not None], default=None)), len(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g)


def run(df, **kw):
    return exact_dedup(df, **kw).collect()


def test_against_brute_force(spark):
    df = spark.createDataFrame(ROWS, "doc_id bigint, text string")
    for keep, best in (("smallest", min), ("largest", max)):
        got = run(df, keep=keep)
        assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in got) == brute(ROWS, best)
        kept = [r for r in got if r.kept]
        assert len(kept) == len({r.text_sha256 for r in got})
        assert all(r.doc_id == r.keep_id for r in kept)


def test_digest_collisions_keep_texts_apart(spark):
    df = spark.createDataFrame(ROWS, "doc_id bigint, text string")
    weak = run(df, digest=lambda t: F.lit("00" * 16))
    assert sorted((str(r.doc_id), r.group_size, r.kept) for r in weak) == sorted((str(r.doc_id), r.group_size, r.kept) for r in run(df))


def test_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame(ROWS, "doc_id bigint, text string")
    assert run(df.limit(0)) == []
    odd = df.selectExpr("*", "'mine' AS KEPT", "1 AS group_size", "array(1) AS `a.b`", "map(1, 2) AS m", "CAST(NULL AS string) AS source")
    got = run(odd)
    assert len(got) == len(ROWS) and {r["a.b"][0] for r in got} == {1}
    assert all(isinstance(r.kept, bool) for r in got)


def test_hot_group_is_found_whole(spark):
    df = spark.range(6000).selectExpr("id AS doc_id", "IF(id % 3 = 0, 'hot', CAST(id AS string)) AS text")
    got = exact_dedup(df).groupBy("group_size").count().collect()
    assert {(r.group_size, r["count"]) for r in got} == {(2000, 2000), (1, 4000)}


def test_attach_finds_hot_and_cold_keys(spark):
    rows = spark.range(5000).selectExpr("id", "IF(id % 2 = 0, -1, id % 700) AS k")
    groups = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("top")).where("k <> 3")
    got = attach(rows, groups, ["k"], ["top"], "n", ["id"]).join(groups.select("k", F.col("top").alias("want")), "k", "left")
    assert got.count() == 5000 and got.where("NOT top <=> want").count() == 0


def test_columns_named_like_private_ones_stay(spark):
    docs = spark.createDataFrame([(1, "A", 5, 6, 7, 8), (2, "a", 5, 6, 7, 9), (2, "a", 5, 6, 7, 9)], "doc_id int, text string, __t int, __s int, __hot int, KEPT int")
    out = exact_dedup(docs)
    assert out.columns == ["doc_id", "text", "__t", "__s", "__hot", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted((r["doc_id"], r["__t"], r["__s"], r["__hot"], r["keep_id"], r["group_size"], r["kept"]) for r in out.collect()) == [(1, 5, 6, 7, 1, 3, True), (2, 5, 6, 7, 1, 3, False), (2, 5, 6, 7, 1, 3, False)]
