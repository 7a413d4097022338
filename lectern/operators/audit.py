"""Audit rules, in array form: one row a document in, one array of findings
out. No shuffle, so it scales with the scan and runs on streams as it is.

Rules sit in a registry by grain; each is a function from the columns of its
grain to an array of (rule, line) structs, so a finding's multiplicity is the
length of its array.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import text as T
from .parse import parse

FINDINGS = "array<struct<rule:string,line:int>>"
Maker = Callable[..., Column]
DOCUMENT: dict[str, Maker] = {}
BLOCK: dict[str, Maker] = {}
SENTENCE: dict[str, Maker] = {}
LINE: dict[str, Maker] = {}


def rule(registry: dict[str, Maker], code: str) -> Callable[[Maker], Maker]:
    def add(f: Maker) -> Maker:
        registry[code] = f
        return f

    return add


def none() -> Column:
    return F.array().cast(FINDINGS)


def hit(code: str, line: Column) -> Column:
    return F.struct(F.lit(code).alias("rule"), line.cast("int").alias("line"))


def once(code: str, when: Column, line: Column) -> Column:
    return F.when(when, F.array(hit(code, line))).otherwise(none())


def times(code: str, n: Column, line: Column) -> Column:
    return F.when(n > 0, F.array_repeat(hit(code, line), n.cast("int"))).otherwise(none())


def each(code: str, items: Column, line: Callable[[Column], Column]) -> Column:
    return F.transform(items, lambda x: hit(code, line(x)))


def lines_at(array: Column, test: Callable[[Column, Column], Column]) -> Column:
    """Indexes (from 0) of the elements that pass."""
    return F.filter(F.transform(array, lambda x, i: F.when(test(x, i), i)), lambda i: i.isNotNull())


def limit(name: str, lang: Column) -> Column:
    return F.when(lang == "zh", C.LIMITS["zh"][name]).otherwise(C.LIMITS["en"][name])


def is_prose(b: Column) -> Column:
    return b["kind"].isin("para", "quote")


def is_toc(b: Column) -> Column:
    return (b["kind"] == "list") & (F.size(F.filter(b["lines"], lambda x: F.contains(x, F.lit("](#")))) >= 2)


def body_text(b: Column) -> Column:
    return F.array_join(b["lines"], "\n")


# -- what every rule reads -------------------------------------------------


def language(prose: Column) -> Column:
    """zh or en, by the share of CJK characters in the readable text of blocks."""
    zh, en = (F.aggregate(F.transform(prose, f), F.lit(0), lambda a, x: a + x) for f in (T.cjk_chars, T.latin_words))
    return F.when(zh / F.greatest(zh + en, F.lit(1)) > 0.30, "zh").otherwise("en")


def prepare(docs: DataFrame) -> DataFrame:
    """parse(docs) plus lang, body (blocks with prose, units and sentences),
    heads and the document's totals, each computed once."""
    rows = parse(docs).withColumn("body", F.filter("blocks", lambda b: b["kind"] != "frontmatter"))
    rows = rows.withColumn("prose", F.transform("body", lambda b: T.prose(b)))
    rows = rows.withColumn("lang", language(F.col("prose")))
    lang = F.col("lang")
    flat = lambda p: F.when(lang == "zh", T.sub(p, "\n+", "")).otherwise(T.sub(p, "\n+", " "))
    extra = lambda b, p: F.struct(
        *[b[c].alias(c) for c in ("kind", "start", "end", "lines", "lang", "closed", "level", "title", "cols", "rows", "items")],
        p.alias("prose"),
        T.units(p, lang).alias("units"),
        F.when(is_prose(b), F.transform(T.sentences(flat(p), lang), lambda s: F.struct(s.alias("text"), T.units(s, lang).alias("units")))).alias("sentences"),
        is_toc(b).alias("toc"),
    )
    rows = rows.withColumn("body", F.zip_with("body", "prose", extra)).drop("prose")
    heads = F.filter("body", lambda b: b["kind"] == "heading")
    rows = rows.withColumns({"heads": heads, "n_heads": F.size(heads)})
    bold = F.aggregate(F.transform(F.flatten(F.transform(F.filter("body", lambda b: b["kind"] != "code"), lambda b: F.regexp_extract_all(body_text(b), F.lit(T.rx(r"\*\*([^*]+)\*\*")), F.lit(1)))), F.char_length), F.lit(0), lambda a, x: a + x)
    solid = F.aggregate(F.transform(F.filter("body", lambda b: b["kind"] != "heading"), lambda b: F.char_length(T.sub(b["prose"], r"\s", ""))), F.lit(0), lambda a, x: a + x)
    return rows.withColumns({"bold": bold, "solid": F.greatest(solid, F.lit(1)), "sections": sections()})


def sections() -> Column:
    """(start, units, structured, headed) of the text before the first heading
    and of each heading's text."""
    body = F.col("body")
    cuts = F.concat(F.array(F.lit(-1)), lines_at(body, lambda b, _: b["kind"] == "heading"), F.array(F.size(body)))
    checkbox = r"(?m)^\s*[-*+]\s+\[[ xX]\]"

    def section(k: Column) -> Column:
        at, after = F.get(cuts, k), F.get(cuts, k + 1)
        inner = F.slice(body, at + 2, F.greatest(after - at - 1, F.lit(0)))
        total = F.aggregate(F.transform(inner, lambda b: b["units"]), F.lit(0), lambda a, x: a + x)
        structured = F.exists(inner, lambda b: (b["kind"] == "code") | ((b["kind"] == "list") & T.matches(body_text(b), checkbox)))
        return F.struct(F.when(at < 0, 1).otherwise(F.get(body, at)["start"]).alias("start"), total.alias("units"), structured.alias("structured"), (at >= 0).alias("headed"))

    return F.transform(F.sequence(F.lit(0), F.size(cuts) - 2), section)


# -- document rules ----------------------------------------------------------


@rule(DOCUMENT, "S1")
def heading_jump(c) -> Column:
    jumps = lines_at(c["heads"], lambda h, i: (i > 0) & (h["level"] > F.get(c["heads"], i - 1)["level"] + 1))
    return each("S1", jumps, lambda i: F.get(c["heads"], i)["start"])


@rule(DOCUMENT, "S2")
def one_title(c) -> Column:
    first = F.filter(c["heads"], lambda h: h["level"] == 1)
    return once("S2", F.size(first) != 1, F.coalesce(F.get(first, F.lit(1))["start"], F.lit(1)))


@rule(DOCUMENT, "S3")
def long_section(c) -> Column:
    return each("S3", F.filter(c["sections"], lambda s: s["units"] > limit("section", c["lang"])), lambda s: s["start"])


def lead(c) -> Column:
    """Blocks before the first lower heading that is no summary, up to line 25."""
    body = c["body"]
    stops = lines_at(body, lambda b, _: ((b["kind"] == "heading") & (b["level"] >= 2) & ~T.matches(b["title"], C.TLDR)) | (b["start"] > 25))
    return F.slice(body, F.lit(1), F.coalesce(F.get(stops, F.lit(0)), F.size(body)))


def concluded(c) -> Column:
    telling = F.filter(c["lead"], lambda b: (b["kind"] == "list") & ~b["toc"] | (is_prose(b) & ~T.matches(b["prose"], C.BACKGROUND)))
    first = F.get(telling, F.lit(0))
    short = F.when(first["kind"] == "list", F.size(first["items"]) <= 5).otherwise((F.size(T.sentences(first["prose"], c["lang"])) <= 3) & (first["units"] <= limit("lead", c["lang"])))
    return c["named"] | F.coalesce(short, F.lit(False))


@rule(DOCUMENT, "H1")
def no_conclusion(c) -> Column:
    return once("H1", ~c["concluded"], F.lit(1))


@rule(DOCUMENT, "H2")
def long_conclusion(c) -> Column:
    over = F.filter(c["lead"], lambda b: ((b["kind"] == "list") & ~b["toc"] & (F.size(b["items"]) > 5)) | ((b["kind"] == "para") & (b["units"] > limit("tldr", c["lang"])) & c["named"]))
    return once("H2", c["concluded"] & (F.size(over) > 0), F.get(over, F.lit(0))["start"])


@rule(DOCUMENT, "W1m")
def mean_sentence(c) -> Column:
    n = F.filter(F.flatten(F.transform(F.filter(c["body"], is_prose), lambda b: F.transform(b["sentences"], lambda s: s["units"]))), lambda u: u > 0)
    mean, most = F.aggregate(n, F.lit(0).cast("double"), lambda a, x: a + x) / F.size(n), limit("mean", c["lang"]).cast("double")
    over = (mean - most) / most
    copies = F.floor(over / F.lit(0.10)) + F.when(over % F.lit(0.10) != 0, 1).otherwise(0)
    return F.when((F.size(n) > 0) & (mean > most), times("W1m", copies, F.lit(1))).otherwise(none())


@rule(DOCUMENT, "M5")
def dashes(c) -> Column:
    found = F.flatten(F.transform(F.filter(c["body"], is_prose), lambda b: F.flatten(F.transform(b["lines"], lambda x, i: F.array_repeat(b["start"] + i, T.count(T.unquoted(x), C.DASH))))))
    han = F.aggregate(F.transform(F.filter(c["body"], lambda b: b["kind"] != "heading"), lambda b: T.cjk_chars(b["prose"])), F.lit(0), lambda a, x: a + x)
    budget = F.greatest(F.lit(3), F.floor(han * 8 / 1000).cast("int"))
    return each("M5", F.slice(found, budget + 1, F.greatest(F.size(found) - budget, F.lit(0))), lambda line: line)


@rule(DOCUMENT, "M10")
def metaphor(c) -> Column:
    found = F.flatten(F.transform(F.filter(c["body"], lambda b: b["kind"] != "code"), lambda b: F.transform(lines_at(b["lines"], lambda x, _: T.matches(x, C.METAPHOR) & T.matches(T.unquoted(x), C.METAPHOR)), lambda i: b["start"] + i)))
    return once("M10", F.size(found) > 0, F.get(found, F.lit(0)))


@rule(DOCUMENT, "N1")
def no_contents(c) -> Column:
    return once("N1", (c["n_lines"] > 80) & ~F.exists(F.slice(c["body"], F.lit(1), F.lit(12)), lambda b: b["toc"]), F.lit(1))


@rule(DOCUMENT, "T2d")
def bold_density(c) -> Column:
    return once("T2d", c["bold"] / c["solid"] > 0.08, F.lit(1))


@rule(DOCUMENT, "X5")
def bold_flood(c) -> Column:
    return once("X5", c["bold"] / c["solid"] > 0.12, F.lit(1))


@rule(DOCUMENT, "T4")
def line_ends(c) -> Column:
    trailing = lines_at(c["lines"], lambda x, _: T.matches(x, r"[ \t]+$") & ~T.matches(x, r"(?<!\s) {2}$"))
    return F.concat(
        once("T4", F.size(trailing) > 0, F.get(trailing, F.lit(0)) + 1),
        once("T4", ~F.endswith(c["raw"], F.lit("\n")) | F.endswith(c["raw"], F.lit("\n\n")), c["n_lines"]),
    )


@rule(DOCUMENT, "X1p")
def emoji_in_prose(c) -> Column:
    return once("X1p", F.exists(c["body"], lambda b: ~b["kind"].isin("heading", "code") & (T.emoji_count(b["prose"]) > 0)), F.lit(1))


@rule(DOCUMENT, "X1c")
def emoji_policy(c) -> Column:
    n = F.aggregate(F.transform(F.filter(c["body"], lambda b: b["kind"] != "code"), lambda b: T.emoji_count(body_text(b))), F.lit(0), lambda a, x: a + x)
    return once("X1c", ((c["emoji"] == "none") & (n > 0)) | (n > F.greatest(F.lit(1), c["n_heads"])), F.lit(1))


@rule(DOCUMENT, "X2")
def fragments(c) -> Column:
    plain = F.transform(F.filter(c["sections"], lambda s: s["headed"] & ~s["structured"]), lambda s: s["units"])
    mean = F.aggregate(plain, F.lit(0), lambda a, x: a + x) / F.size(plain)
    return F.concat(
        once("X2", (c["n_heads"] > 0) & (c["n_lines"] < 5 * c["n_heads"]), F.lit(1)),
        once("X2", (F.size(plain) >= 3) & (mean < limit("fragment", c["lang"])), F.lit(1)),
    )


@rule(DOCUMENT, "L3")
def unordered_steps(c) -> Column:
    def steps(b: Column) -> Column:
        title = F.get(F.reverse(F.filter(c["heads"], lambda h: h["start"] < b["start"])), F.lit(0))["title"]
        return (b["kind"] == "list") & ~b["toc"] & (F.size(b["items"]) >= 3) & T.matches(F.get(b["lines"], F.get(b["items"], F.lit(0))), T.UL) & F.coalesce(T.matches(title, C.STEPS), F.lit(False))

    return each("L3", F.filter(c["body"], steps), lambda b: b["start"])


# -- block rules ---------------------------------------------------------------


def on(code: str, test: Callable[[Column, dict], Column]) -> None:
    BLOCK[code] = lambda b, c: once(code, test(b, c), b["start"])


def indents(b: Column) -> Column:
    return F.transform(b["items"], lambda i: F.char_length(F.replace(F.regexp_extract(F.get(b["lines"], i), r"^(\s*)", 1), F.lit("\t"), F.lit("    "))))


def flat_list(b: Column) -> Column:
    return (b["kind"] == "list") & ~b["toc"]


on("P1", lambda b, c: is_prose(b) & ((F.size(T.sentences(b["prose"], c["lang"])) > 3) | (b["units"] > limit("para", c["lang"]))))
on("P4", lambda b, c: is_prose(b) & (F.size(b["lines"]) > 6))
on("L1", lambda b, c: flat_list(b) & (F.coalesce(F.array_max(indents(b)), F.lit(0)) >= 4))
on("L6", lambda b, c: flat_list(b) & (F.size(b["items"]) > 7))
on("N5", lambda b, c: (b["kind"] == "table") & ((b["cols"] > 5) | (b["rows"] > 10)))
on("T1", lambda b, c: (b["kind"] == "code") & (F.coalesce(b["block_lang"], F.lit("")) == ""))
on("T8", lambda b, c: (b["kind"] == "html") & ~T.matches(F.get(b["lines"], F.lit(0)), r"^\s*</?(?:details|summary|br)\b"))
on("T2p", lambda b, c: is_prose(b) & (T.count(body_text(b), r"\*\*[^*]+\*\*") > 2))
on("M12", lambda b, c: (b["kind"] == "para") & T.matches(T.sub(b["prose"], "\n+", ""), C.OPENERS))


@rule(BLOCK, "L5")
def long_items(b, c) -> Column:
    def lines(k: Column) -> Column:
        at, after = F.get(b["items"], k), F.coalesce(F.get(b["items"], k + 1), F.size(b["lines"]))
        return F.size(F.filter(F.slice(b["lines"], at + 1, after - at), lambda x: T.trim(x) != ""))

    long = F.filter(F.transform(b["items"], lambda x, k: F.when(lines(k) > 2, x)), lambda x: x.isNotNull())
    return F.when(flat_list(b), each("L5", long, lambda x: b["start"] + x)).otherwise(none())


@rule(BLOCK, "T7")
def numbering(b, c) -> Column:
    top = F.filter(F.transform(b["items"], lambda i: F.regexp_extract(F.get(b["lines"], i), r"^(\d+)[.)]\s", 1)), lambda x: x != "")
    n = F.transform(top, lambda x: x.cast("decimal(38,0)"))
    wrong = F.exists(F.sequence(F.lit(1), F.greatest(F.size(n) - 1, F.lit(1))), lambda k: F.coalesce(F.get(n, k) != F.get(n, k - 1) + 1, F.lit(False)))
    return once("T7", (b["kind"] == "list") & (F.size(n) > 1) & wrong, b["start"])


@rule(BLOCK, "A4")
def prompts(b, c) -> Column:
    last = F.when(b["closed"], F.size(b["lines"]) - 1).otherwise(F.size(b["lines"]))
    found = lines_at(b["lines"], lambda x, i: (i > 0) & (i < last) & T.matches(x, C.PROMPT))
    return F.when(b["kind"] == "code", each("A4", found, lambda i: b["start"] + i)).otherwise(none())


@rule(BLOCK, "C8")
def soft_wrap(b, c) -> Column:
    found = lines_at(b["lines"], lambda x, i: (i < F.size(b["lines"]) - 1) & T.matches(x, rf"[{C.CJK}\p{{L}}\p{{N}}]\s*$"))
    return once("C8", (c["lang"] == "zh") & (b["kind"] == "para") & (F.size(found) > 0), b["start"] + F.get(found, F.lit(0)))


# -- sentence rules (paragraphs and quotes) ------------------------------------------


@rule(SENTENCE, "W1x")
def long_sentence(s, b, c) -> Column:
    return once("W1x", s["units"] > limit("single", c["lang"]), b["start"])


@rule(SENTENCE, "C3")
def comma_run(s, b, c) -> Column:
    return once("C3", (c["lang"] == "zh") & (s["units"] > 45) & (T.count(s["text"], "[，,]") >= 4), b["start"])


@rule(SENTENCE, "C5")
def de_chain(s, b, c) -> Column:
    return once("C5", (c["lang"] == "zh") & (c["level"] >= 3) & (s["units"] > 0) & (T.count(s["text"], "的") >= 3), b["start"])


@rule(SENTENCE, "M11")
def vague(s, b, c) -> Column:
    return F.when(c["lang"] == "zh", times("M11", sum(T.count(s["text"], p) for p in C.VAGUE), b["start"])).otherwise(none())


@rule(SENTENCE, "M13")
def claims(s, b, c) -> Column:
    # a claim counts unless a digit stands within ten characters of it
    bare = T.count(s["text"], rf"(?<!\d[^\n]{{0,9}})(?:{C.CLAIM})(?![^\n]{{0,9}}\d)")
    return F.when(c["lang"] == "zh", times("M13", bare, b["start"])).otherwise(none())


@rule(SENTENCE, "M14")
def chains(s, b, c) -> Column:
    return once("M14", (c["lang"] == "zh") & (T.count(s["text"], C.CHAIN) >= 2), b["start"])


# -- line rules (all kinds but code and frontmatter) ------------------------------------


def occurrences(code: str, phrases: list[str]) -> None:
    def found(v, line, c):
        n = sum(F.try_divide(F.char_length(v["plain"]) - F.char_length(F.replace(v["plain"], F.lit(p.lower()))), F.lit(len(p))).cast("int") for p in phrases)
        return times(code, n, line)

    LINE[code] = found


def per_phrase(code: str, phrases: list[str], column: str) -> None:
    LINE[code] = lambda v, line, c: times(code, sum(F.contains(v[column], F.lit(p.lower() if column == "low" else p)).cast("int") for p in phrases), line)


def per_match(code: str, patterns: list[str]) -> None:
    """Patterns with CJK text are only tried on lines that hold such text."""
    chinese = [p for p in patterns if any(x > "\u2fff" for x in p)]
    other = [p for p in patterns if p not in chinese]
    n = lambda v, ps: sum((T.count(v["open"], p) for p in ps), F.lit(0))
    LINE[code] = lambda v, line, c: times(code, F.when(v["han"], n(v, chinese)).otherwise(0) + n(v, other), line)


occurrences("W4", C.BACK_REFERENCES)
occurrences("W6", C.FILLERS)
per_match("M1", C.PIVOT)
per_match("M3", [C.LYRIC])
per_match("M4", C.NOMINAL)
per_match("M6", [C.TEASER])
per_phrase("M7", C.EMPTY_OPENERS, "open")
per_phrase("M8", C.ROAD_SIGNS, "low")
per_phrase("M9", C.JARGON, "low")
LINE["C1"] = lambda v, line, c: once("C1", (c["lang"] == "zh") & T.matches(v["safe"], rf"[{C.CJK}][A-Za-z0-9]|[A-Za-z0-9][{C.CJK}]"), line)
LINE["C2"] = lambda v, line, c: once("C2", (c["lang"] == "zh") & T.matches(v["safe"], rf"[{C.CJK}][,;:!?]|[{C.CJK}]\.(?![A-Za-z0-9])"), line)
LINE["M2"] = lambda v, line, c: once("M2", v["pairs"] & T.matches(v["open"], C.ANAPHORA) & ~T.matches(v["open"], "[`（(/]"), line)


def link_rules(v, line, c) -> Column:
    """N2 and N6 on text with only inline code masked; off under strict_compat,
    where the mask hides every link before these rules look."""
    shown = T.sub(v["raw"], T.INLINE_CODE, "\u0000")
    bad = "|".join(C.BAD_LINK_TEXTS)
    weak = T.count(shown, rf"(?<!!)\[(?i:\s*(?:{bad}|.?)\s*)\]\([^)\s]*[^)]*\)")
    return F.concat(times("N2", weak + T.count(shown, r"(?<![(<\w])https?://\S+"), line), times("N6", T.count(shown, r"!\[\s*\]\([^)\s]*[^)]*\)"), line))


# -- the operator -------------------------------------------------------------------


def audit(docs: DataFrame, level: int = 2, emoji: str = "none", strict_compat: bool = True) -> DataFrame:
    """docs plus lang, n_lines and findings (array of rule, line).

    docs: doc_id and raw; optional columns level and emoji override the
    arguments row by row. Level 3 adds C5.
    """
    for name, value in (("level", level), ("emoji", emoji)):
        if name not in docs.columns:
            docs = docs.withColumn(name, F.lit(value))
    rows = prepare(docs)
    c = {n: F.col(n) for n in ("raw", "lines", "n_lines", "body", "heads", "n_heads", "sections", "bold", "solid", "lang", "level", "emoji", "lead", "named", "concluded")}
    # what rules share is a column, so that it is computed once
    rows = rows.withColumn("lead", lead(c))
    rows = rows.withColumn("named", F.exists("lead", lambda b: T.matches(body_text(b), C.TLDR)))
    rows = rows.withColumn("concluded", concluded(c))

    def blockwise(b: Column) -> Column:
        own = {n: b[n] for n in ("kind", "start", "lines", "closed", "cols", "rows", "items", "prose", "units", "toc", "sentences")} | {"block_lang": b["lang"]}
        return F.concat(*[f(own, c) for f in BLOCK.values()])

    def sentencewise(b: Column) -> Column:
        per = F.transform(b["sentences"], lambda s: F.concat(*[f(s, b, c) for f in SENTENCE.values()]))
        return F.coalesce(F.flatten(per), none())

    def linewise(b: Column) -> Column:
        # in three steps, each view made of the one before
        views = F.transform(b["lines"], lambda x: F.struct(x.alias("raw"), T.protect(x).alias("safe")))
        views = F.transform(views, lambda v: F.struct(v["raw"].alias("raw"), v["safe"].alias("safe"), T.sub(v["safe"], C.QUOTED, "  ").alias("open")))
        han, pairs = lambda x: T.matches(x, f"[{C.CJK}]"), lambda x: T.matches(x, "[，、]")
        views = F.transform(views, lambda v: v.withField("plain", F.lower(T.strip_inline(v["raw"]))).withField("low", F.lower(v["open"])).withField("han", han(v["raw"])).withField("pairs", pairs(v["raw"])))
        rules = [*LINE.values()] + ([] if strict_compat else [link_rules])
        return F.when(b["kind"] == "code", none()).otherwise(F.flatten(F.transform(views, lambda v, i: F.concat(*[f(v, b["start"] + i, c) for f in rules]))))

    parts = [F.concat(*[f(c) for f in DOCUMENT.values()]), *[F.flatten(F.transform("body", f)) for f in (blockwise, sentencewise, linewise)]]
    return rows.withColumn("findings", F.concat(*[F.coalesce(p, none()) for p in parts])).drop("blocks", "lines", "body", "heads", "sections", "bold", "solid", "lead", "named", "concluded")


AXES = {r[0]: r[4] for r in C.RULES} | dict.fromkeys([*C.GLOBAL_RULES, "M10"], "F") | {"M2": "C", "M10": "C"}


def _looked_up(table: dict[str, str], rule: Column, missing: str) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), rule), F.lit(missing))


def axis(rule: Column) -> Column:
    """F (form) or C (content)."""
    return _looked_up(AXES, rule, "?")


def message(rule: Column) -> Column:
    return _looked_up(C.MESSAGES, rule, "")


def findings(audited: DataFrame) -> DataFrame:
    """doc_id, rule, line, axis, advisory, message: a row per finding."""
    # outer: else a filter on the array's size would be pushed through all the
    # projections below, each time with its whole expression
    rows = audited.select("doc_id", F.inline_outer("findings")).where(F.col("rule").isNotNull())
    return rows.withColumns({"axis": axis(F.col("rule")), "advisory": F.col("rule").isin(*C.ADVISORY), "message": message(F.col("rule"))})
