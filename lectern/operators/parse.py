"""Markdown block parser: the one operator that needs sequential state.

It runs once per document in an Arrow-batched UDF; everything after it is
column expressions over the block array.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = "struct<kind:string,start:int,`end`:int,lines:array<string>,lang:string,closed:boolean,level:int,title:string,cols:int,rows:int,items:array<int>>"
HEADING = re.compile(r"(#{1,6})\s+(.*)\Z")
RULE = re.compile(r"\s*([-*_])(?:\s*\1){2,}\s*\Z")
FENCE = re.compile(r"\s*(`{3,}|~{3,})\s*(\S*)")
ITEM = re.compile(r"\s*(?:[-*+]|\d+[.)])\s+")
QUOTE = re.compile(r"\s*>")
SEPARATOR = re.compile(r"\s*\|?[\s:|-]*-[\s:|-]*\|?\s*\Z")
HTML = re.compile(r"\s*</?[A-Za-z][^>]*>")


class Scanner:
    """Lines of a document with, per line, what it could begin; each reader
    returns the line after its block and the block's own fields."""

    def __init__(self, raw: str):
        self.lines = raw.split("\n")
        if self.lines and not self.lines[-1]:
            self.lines.pop()
        self.readers: list[tuple[Callable[[str], object], Callable]] = [
            (FENCE.match, self.code), (HEADING.match, self.heading), (RULE.match, self.rule), (lambda s: "|" in s, self.table),
            (QUOTE.match, self.quote), (ITEM.match, self.items), (HTML.match, self.html), (lambda s: True, self.para),
        ]

    def at(self, i: int) -> str | None:
        return self.lines[i] if i < len(self.lines) else None

    def interrupts(self, line: str, html: bool = True) -> bool:
        return any(p.match(line) for p in (HEADING, RULE, FENCE, ITEM, QUOTE, *([HTML] if html else [])))

    def run_on(self, i: int, more: Callable[[str], object]) -> int:
        while (line := self.at(i)) is not None and more(line):
            i += 1
        return i

    def blocks(self) -> list[dict]:
        out, i = [], 0
        if self.lines and self.lines[0].strip() == "---":
            closing = next((k for k in range(1, len(self.lines)) if self.lines[k].strip() == "---"), None)
            if closing is not None:
                out.append(self.block("frontmatter", 0, closing + 1))
                i = closing + 1
        while (line := self.at(i)) is not None:
            if not line.strip():
                i += 1
                continue
            for starts, read in self.readers:
                if starts(line) and (found := read(i)):
                    kind, after, fields = found
                    out.append(self.block(kind, i, after, **fields))
                    i = after
                    break
        return out

    def block(self, kind: str, start: int, after: int, **fields) -> dict:
        base = dict.fromkeys(("lang", "closed", "level", "title", "cols", "rows", "items"))
        return {"kind": kind, "start": start + 1, "end": after, "lines": self.lines[start:after]} | base | fields

    def code(self, i: int):
        fence, lang = FENCE.match(self.lines[i]).groups()
        end = re.compile(rf"\s*{re.escape(fence[0])}{{{len(fence)},}}\s*\Z")
        close = self.run_on(i + 1, lambda s: not end.match(s))
        closed = close < len(self.lines)
        return "code", close + closed, {"lang": lang, "closed": closed}

    def heading(self, i: int):
        marks, title = HEADING.match(self.lines[i]).groups()
        return "heading", i + 1, {"level": len(marks), "title": title.strip()}

    def rule(self, i: int):
        return "hr", i + 1, {}

    def table(self, i: int):
        below = self.at(i + 1)
        if below is None or "|" not in below or not SEPARATOR.match(below):
            return None
        after = self.run_on(i, lambda s: "|" in s)
        cells = [len(s.strip().strip("|").split("|")) for s in self.lines[i:after]]
        return "table", after, {"cols": max(cells), "rows": after - i - 2}

    def quote(self, i: int):
        return "quote", self.run_on(i, lambda s: QUOTE.match(s) or (s.strip() and not self.interrupts(s))), {}

    def items(self, i: int):
        j, offsets = i, []
        while (line := self.at(j)) is not None:
            if not line.strip():
                ahead = self.at(j + 1)
                if ahead is None or not (ITEM.match(ahead) or ahead.startswith(("  ", "\t"))):
                    break
            elif ITEM.match(line):
                offsets.append(j - i)
            elif not line.startswith((" ", "\t")) and self.interrupts(line):
                break
            j += 1
        return "list", j, {"items": offsets}

    def html(self, i: int):
        return "html", i + 1, {}

    def para(self, i: int):
        return "para", max(i + 1, self.run_on(i, lambda s: s.strip() and not self.interrupts(s, html=False))), {}


def blocks_of(raw: pd.Series) -> pd.Series:
    return raw.map(lambda t: Scanner(t or "").blocks())


def parse(docs: DataFrame) -> DataFrame:
    """docs (doc_id, raw, ...) plus n_lines, lines and blocks (frontmatter
    included). A null raw counts as empty; line endings are taken as line feeds."""
    raw = F.coalesce(F.regexp_replace("raw", "\r\n?", "\n"), F.lit(""))
    rows = docs.withColumn("raw", raw).withColumn("blocks", F.pandas_udf(blocks_of, f"array<{BLOCK}>")("raw"))
    lines = F.split("raw", "\n")
    lines = F.when(F.endswith("raw", F.lit("\n")) | (F.col("raw") == ""), F.slice(lines, F.lit(1), F.size(lines) - 1)).otherwise(lines)
    return rows.withColumn("lines", lines).withColumn("n_lines", F.size("lines"))


def exploded_blocks(docs: DataFrame) -> DataFrame:
    """doc_id, block_no and the block's fields, a row per block."""
    return parse(docs).select("doc_id", F.posexplode("blocks").alias("block_no", "b")).select("doc_id", "block_no", "b.*")
