"""Text functions as Spark columns. Patterns get (?Ud), so classes follow
Unicode and a dot stops at line feeds only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import BANDS, CJK, EMOJI, FOLD_FROM, FOLD_TO, QUOTED

INLINE_CODE = "`+[^`\n]*?`+"
LINK = r"!?\[([^\]]*)\]\(([^)\s]*)[^)]*\)"
TAG = r"</?[A-Za-z][^>]*>"
PROTECTED = rf"{INLINE_CODE}|\]\([^)]*\)|{TAG}|(?<![(\w])https?://\S+"
UL, OL = r"^(\s*)([-*+])\s+(.*)$", r"^(\s*)(\d+)([.)])\s+(.*)$"
SEPARATOR = r"^\s*\|?[\s:|-]*-[\s:|-]*\|?\s*$"


def rx(pattern: str) -> str:
    return "(?Ud)" + pattern


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(rx(pattern)))


def matches(text: Column, pattern: str) -> Column:
    return text.rlike(rx(pattern))


def sub(text: Column, pattern: str, by: str) -> Column:
    return F.regexp_replace(text, rx(pattern), by)


def trim(text: Column) -> Column:
    return sub(text, r"^\s+|\s+$", "")


def strip_inline(text: Column, keep_code: bool = False) -> Column:
    """Readable text: links leave their text; code, tags and emphasis go."""
    out = sub(text, LINK, "$1")
    out = out if keep_code else sub(out, INLINE_CODE, " ")
    return sub(sub(out, TAG, ""), "[*_~]{1,3}", "")


def protect(line: Column) -> Column:
    """Inline code, link targets, tags and bare URLs become a NUL."""
    return sub(line, PROTECTED, "\u0000")


def unquoted(line: Column) -> Column:
    """Protected text with corner-quoted mentions blanked."""
    return sub(protect(line), QUOTED, "  ")


def cjk_chars(text: Column) -> Column:
    return count(text, f"[{CJK}]")


def latin_words(text: Column) -> Column:
    return count(text, "[A-Za-z][A-Za-z'’-]*")


def units(text: Column, lang: Column) -> Column:
    return F.when(lang == "zh", cjk_chars(text)).otherwise(latin_words(text))


def sentences(text: Column, lang: Column) -> Column:
    zh = F.split(trim(text), rx(r"(?<=[。！？；…])|\n+"))
    en = F.split(trim(text), rx(r"(?<=[.!?;])\s+(?=[A-Z\"'(\[])|\n{2,}|\n(?=[-*#])"))
    return F.filter(F.transform(F.when(lang == "zh", zh).otherwise(en), trim), lambda s: s != "")


def emoji_count(text: Column) -> Column:
    return count(text, EMOJI)


def item_body(line: Column) -> Column:
    """A list line without its bullet or number."""
    return F.when(matches(line, UL), F.regexp_extract(line, rx(UL), 3)).when(matches(line, OL), F.regexp_extract(line, rx(OL), 4)).otherwise(trim(line))


def prose(block: Column, keep_code: bool = False) -> Column:
    """Readable text of a block, by its kind."""
    kind, lines = block["kind"], block["lines"]
    strip = lambda x: strip_inline(x, keep_code)
    rows = F.filter(lines, lambda r: ~matches(r, SEPARATOR))
    cells = F.flatten(F.transform(rows, lambda r: F.transform(F.split(sub(trim(r), r"^\|+|\|+$", ""), r"\|"), lambda c: strip(trim(c)))))
    return (
        F.when(kind.isin("code", "frontmatter", "hr"), "")
        .when(kind == "heading", strip(block["title"]))
        .when(kind == "list", F.array_join(F.transform(lines, lambda x: strip(item_body(x))), "\n"))
        .when(kind == "quote", strip(F.array_join(F.transform(lines, lambda x: sub(x, r"^\s*>\s?", "")), "\n")))
        .when(kind == "table", F.array_join(F.filter(cells, lambda c: c != ""), " "))
        .otherwise(strip(F.array_join(lines, "\n")))
    )


def fold(text: Column) -> Column:
    """Full-width punctuation to ASCII."""
    return F.replace(F.translate(text, FOLD_FROM, FOLD_TO), F.lit("…"), F.lit("..."))


def tokens(text: Column) -> Column:
    """CJK characters one by one, other words lower-cased."""
    word = rf"[{CJK}]|[\p{{L}}\p{{N}}._/\-&&[^{CJK}]]+"
    found = F.regexp_extract_all(fold(text), F.lit(rx(word)), F.lit(0))
    return F.filter(F.transform(found, lambda w: F.lower(sub(w, r"^[._/-]+|[._/-]+$", ""))), lambda w: w != "")


def band(hundredths: Column) -> Column:
    out = F.lit(BANDS[-1][1])
    for least, name in reversed(BANDS[:-1]):
        out = F.when(hundredths >= least * 100, name).otherwise(out)
    return out
