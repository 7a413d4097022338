from pyspark.sql import functions as F

from lectern.operators.audit import audit, findings
from lectern.operators.parse import Scanner
from lectern.operators.rewrite import fmt, rewrite
from lectern.operators.score import score
from lectern.operators.verify import verify
from lectern.plans import corpus


def kinds(text):
    return [b["kind"] for b in Scanner(text).blocks()]


def test_parser_edge_cases():
    assert kinds("```\nx") == ["code"] and Scanner("```\nx").blocks()[0]["closed"] is False
    assert kinds("~~~~\n~~~\n~~~~\n") == ["code"]
    assert kinds("---\ntext\n") == ["hr", "para"]
    assert kinds("---\na: 1\n---\ntext\n") == ["frontmatter", "para"]
    assert kinds("text\n| a |\n|---|\n") == ["para"]
    assert kinds("- a\n\n  b\n") == ["list"] and kinds("- a\n\nb\n") == ["list", "para"]
    assert kinds("- a\nb\n") == ["list"] and kinds("> a\nb\n") == ["quote"]
    assert kinds("a\n<b>\n") == ["para"] and kinds("<https://x.y>\n") == ["html"] and kinds("<!-- c -->\n") == ["para"]


def test_rewrite():
    assert rewrite("# t\ntext  \nmore \n\n\n1. a\n1. b\n") == "# t\n\ntext  \nmore\n\n1. a\n2. b\n"
    assert rewrite("```\na  \n```\n") == "```\na  \n```\n"
    assert rewrite("使用Spark处理,很快.\n", True) == "使用 Spark 处理，很快。\n"
    assert rewrite("用`a,b`和https://x.y/z处理\n", True).count("`a,b`") == 1
    # a fence within a list is no code block, but gets its blank line
    assert rewrite("- item\n  ```\n  x\n  ```\n") == "- item\n\n  ```\n  x\n\n  ```\n"
    for text, _ in corpus.DEFECTS:
        chinese = text.startswith("zh:")
        once = rewrite(corpus.document(text).format(name="x"), chinese)
        assert rewrite(once, chinese) == once


def test_contents_emoji_and_joined_lines():
    parts = "".join(f"## Part {i}\n\ntext\n\n" for i in "abc")
    toc = "- [Part a](#part-a)\n- [Part b](#part-b)\n- [Part c](#part-c)\n\n"
    assert rewrite("# T\n\n" + parts, toc=True).startswith("# T\n\n" + toc)
    assert rewrite("# T\n\n" + toc + parts, toc=True).count("(#part-a)") == 1
    assert rewrite(parts, toc=True).count("(#") == 0  # nothing stands before the first part
    # frontmatter is one of the first twelve blocks
    late = "---\nx: 1\n---\n\n" + "para\n\n" * 11 + toc + parts
    assert rewrite(late, toc=True).count("(#part-a)") == 2 and rewrite(late.replace("para\n\n", "", 1), toc=True).count("(#part-a)") == 1
    assert rewrite("go 🚀 now ✓\n", strip_emoji=True) == "go  now ✓\n"
    assert rewrite("第一行\n第二行 a\nb\n", True, join_cjk=True) == "第一行第二行 a b\n"


def test_one_language_for_audit_and_rewrite(spark):
    texts = ["中文字,好 a_b_c_d_e_f_g_h_i_j\n", "中文字,好 a b c d e f g h i j k\n", "中文<b>a</b>字,好\n", "plain,text\n", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, raw string")
    lang = {r["doc_id"]: r["lang"] for r in audit(df).collect()}
    wide = {r["doc_id"]: "，" in r["formatted"] for r in fmt(df).collect()}
    assert lang == {0: "zh", 1: "en", 2: "zh", 3: "en", 4: "en", 5: "en"}
    assert {i: x == "zh" for i, x in lang.items()} == wide


def test_defects_are_found_and_scored(spark):
    rows = [(i, corpus.document(text).format(name="Customer#000000001"), 3 if "C5" in found else 2) for i, (text, found) in enumerate(corpus.DEFECTS)]
    audited = audit(spark.createDataFrame(rows, "doc_id bigint, raw string, level int"))
    got = {}
    for r in findings(audited).groupBy("doc_id", "rule").agg(F.count(F.lit(1)).alias("n")).collect():
        got.setdefault(r.doc_id, {})[r.rule] = r.n
    assert got == {i: found for i, (_, found) in enumerate(corpus.DEFECTS) if found}
    assert all(0 <= r.total_hundredths <= 10000 for r in score(audited).collect())


def test_verify(spark):
    pairs = [(1, "a b b", "b a b"), (2, "a b b", "a b"), (3, "see https://x.y/z now", "see now"), (4, None, "")]
    df = spark.createDataFrame(pairs, "pair_id bigint, old string, new string")
    got = {r.pair_id: [x.kind for x in r.issues] for r in verify(df).collect()}
    assert got[1] == ["blocks_reordered"] and got[2] == ["prose_tokens_missing"] and got[4] == []
    # identifiers are taken from all text outside code, URLs included: x.y is one
    assert [x.kind for x in verify(df, "content").where("pair_id = 3").first().issues] == ["urls_missing", "idents_missing"]


def test_lost_words_by_count_then_place(spark):
    df = spark.createDataFrame([(1, "b a c a d a b zz\n```\n" + "x" * 200 + "\n```\n", "c zz zz\n"), (2, "---\nmy_key: 4 GB\n---\ntext\n", "text\n")], "pair_id int, old string, new string")
    got = {r["pair_id"]: [(x["kind"], x["count"], x["items"]) for x in r["issues"]] for r in verify(df).collect()}
    assert got[1] == [("code_block_missing", 1, ["x" * 120]), ("prose_tokens_missing", 6, ["a", "b", "d"]), ("prose_tokens_added", 1, ["zz"])]
    assert got[2] == [] and all(r["ok"] for r in verify(df.where("pair_id = 2"), "content").collect())


def test_links_are_audited_without_strict_compat(spark):
    texts = ["See [here](https://x.org/a) now.", "![](a.png)", "Go to https://x.org/a now.", "See [the guide](https://x.org/a).", "`[here](x)` is code."]
    df = spark.createDataFrame([(i, corpus.HEAD.format(name="x") + f"\n\n{t}\n") for i, t in enumerate(texts)], "doc_id int, raw string")
    got = {(r["doc_id"], r["rule"]) for r in findings(audit(df, strict_compat=False)).collect()}
    assert got == {(0, "N2"), (1, "N6"), (2, "N2")} and findings(audit(df)).count() == 0
