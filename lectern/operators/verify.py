"""Lossless check of a rewrite, one row a pair, in array form: multisets are
compared by sorting, containment in the row itself, so pairs never shuffle and
work grows with the number of words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import text as T
from .audit import is_toc
from .parse import BLOCK, blocks_of


def code_blocks(blocks: Column) -> Column:
    """Inner text of each code block, lines right-trimmed, whole trimmed."""

    def inner(b: Column) -> Column:
        n = F.size(b["lines"]) - F.when(b["closed"] & (F.size(b["lines"]) > 1), 2).otherwise(1)
        return T.trim(F.array_join(F.transform(F.slice(b["lines"], F.lit(2), F.greatest(n, F.lit(0))), lambda x: T.sub(x, r"\s+$", "")), "\n"))

    return F.transform(F.filter(blocks, lambda b: b["kind"] == "code"), inner)


def prose_tokens(blocks: Column) -> Column:
    """Tokens of all prose, inline code kept; a table of contents among the
    first twelve blocks left out."""
    shown = F.filter(blocks, lambda b, i: ~b["kind"].isin("code", "frontmatter", "hr") & ~((i < 12) & is_toc(b)))
    return T.tokens(F.array_join(F.transform(shown, lambda b: T.prose(b, keep_code=True)), "\n"))


def without_code(blocks: Column) -> Column:
    """Text outside code and frontmatter."""
    shown = F.filter(blocks, lambda b: ~b["kind"].isin("code", "frontmatter"))
    return F.array_join(F.transform(shown, lambda b: F.array_join(b["lines"], "\n")), "\n")


def distinct(text: Column, pattern: str, group: int = 0) -> Column:
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(T.rx(pattern)), F.lit(group)), T.trim)))


def invariants(raw: Column, blocks: Column) -> dict[str, Column]:
    """What a rewrite of the content has to keep, by kind, in the order of report."""
    prose = without_code(blocks)
    numbers = F.transform(F.regexp_extract_all(prose, F.lit(T.rx(C.NUMBER)), F.lit(0)), lambda x: F.replace(x, F.lit(" ")))
    return {
        "urls": distinct(raw, C.URL),
        "idents": distinct(prose, C.IDENTIFIER),
        "nums": F.array_sort(F.array_distinct(numbers)),
        "inline": distinct(raw, C.SPAN, 1),
    }


def multisets(rows: DataFrame, a: str, b: str) -> DataFrame:
    """rows plus a_only and b_only: (word, count) of the words of one array beyond
    their count in the other, the most frequent first, then by first place.

    Both arrays are sorted as one, so equal words stand together, a's before b's;
    a run's length is its count, and the run beside it is the other array's. Each
    step is a column of its own: inside a lambda it would be computed per element.
    """
    tag = lambda name, side: F.transform(name, lambda w, i: F.struct(w.alias("w"), F.lit(side).alias("side"), i.alias("i")))
    rows = rows.withColumn("__s", F.array_sort(F.concat(tag(a, 0), tag(b, 1))))
    s, n = F.col("__s"), F.size("__s")
    ends = lambda i: (i <= n) & ((i == n) | (F.get(s, i - 1)["w"] != F.get(s, i)["w"]) | (F.get(s, i - 1)["side"] != F.get(s, i)["side"]))
    rows = rows.withColumn("__e", F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), ends))
    begun = lambda k: F.coalesce(F.get("__e", k - 1), F.lit(0))
    run = lambda end, k: F.struct(F.get(s, end - 1)["w"].alias("w"), F.get(s, end - 1)["side"].alias("side"), (end - begun(k)).alias("n"), F.get(s, begun(k))["i"].alias("i"))
    rows = rows.withColumn("__r", F.transform("__e", run))

    def only(side: int) -> Column:
        def beyond(x: Column, k: Column) -> Column:
            beside = F.get("__r", k + (-1 if side else 1))
            return F.struct((F.when(beside["w"] == x["w"], beside["n"]).otherwise(0) - x["n"]).alias("less"), x["i"].alias("i"), x["w"].alias("w"), x["side"].alias("side"))

        found = F.filter(F.transform("__r", beyond), lambda x: (x["side"] == side) & (x["less"] < 0))
        return F.transform(F.array_sort(found), lambda x: F.struct(x["w"].alias("w"), (-x["less"]).alias("n")))

    return rows.withColumns({f"{a}_only": only(0), f"{b}_only": only(1)}).drop("__s", "__e", "__r")


def absent(values: Column, text: Column) -> Column:
    return F.filter(values, lambda x: ~F.contains(text, x))


def verify(pairs: DataFrame, scope: str = "format", keep: tuple[str, ...] = ()) -> DataFrame:
    """pair_id, scope, ok, issues (severity, kind, count, items) and columns to keep.

    pairs: pair_id, old, new; an optional column scope (format, content, both)
    overrides the argument. Null texts count as empty. Hard issues fail a pair;
    warnings don't.
    """
    if "scope" not in pairs.columns:
        pairs = pairs.withColumn("scope", F.lit(scope))
    blocks = F.pandas_udf(blocks_of, f"array<{BLOCK}>")
    rows = pairs.withColumns({s: F.coalesce(F.regexp_replace(s, "\r\n?", "\n"), F.lit("")) for s in ("old", "new")})
    rows = rows.withColumns({"ob": blocks("old"), "nb": blocks("new")})
    rows = rows.withColumns({"ot": prose_tokens(F.col("ob")), "nt": prose_tokens(F.col("nb")), "oc": code_blocks(F.col("ob")), "nc": code_blocks(F.col("nb"))})
    rows = multisets(rows, "ot", "nt").withColumnsRenamed({"ot_only": "lost", "nt_only": "added"})
    kind = "array<struct<severity:string,kind:string,count:bigint,items:array<string>>>"

    def issue(severity: str, name: str, count: Column, items: Column, when: Column) -> Column:
        found = F.struct(F.lit(severity).alias("severity"), F.lit(name).alias("kind"), count.cast("long").alias("count"), items.cast("array<string>").alias("items"))
        return F.when(when & (count > 0), F.array(found)).otherwise(F.array().cast(kind))

    def words(name: str, found: Column) -> Column:
        total = F.aggregate(found, F.lit(0), lambda n, x: n + x["n"])
        return issue("hard", name, total, F.transform(F.slice(found, 1, 20), lambda x: x["w"]), form)

    form = F.col("scope") == "format"
    code = F.filter("oc", lambda x: (x != "") & ~F.array_contains(F.col("nc"), x))
    sample = F.array(F.substring(F.get(code, F.lit(0)), 1, 120))
    found = [issue("hard", C.CODE_LOST, F.size(code), sample, F.lit(True)), words(C.WORDS_LOST, F.col("lost")), words(C.WORDS_ADDED, F.col("added"))]
    moved = (F.size("lost") == 0) & (F.size("added") == 0) & (F.col("ot") != F.col("nt"))
    found.append(issue("warning", C.REORDERED, F.lit(1), F.array(), form & moved))
    squeezed = T.sub(F.col("new"), r"\s+", "")
    for name, values in invariants(F.col("old"), F.col("ob")).items():
        gone = absent(values, squeezed if name == "nums" else F.col("new"))
        found.append(issue("warning" if name == "nums" else "hard", C.INVARIANTS_LOST[name], F.size(gone), F.slice(gone, 1, 12), ~form))
    rows = rows.withColumn("issues", F.concat(*found))
    return rows.select("pair_id", "scope", (~F.exists("issues", lambda x: x["severity"] == "hard")).alias("ok"), "issues", *keep)
