"""Readers that give (doc_id, path, raw)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """Whole UTF-8 files; doc_id is a hash of the path, line endings become
    line feeds."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value"))
    return files.select(F.xxhash64("path").alias("doc_id"), "path", F.regexp_replace("value", "\r\n?", "\n").alias("raw"))


def read_table(spark: SparkSession, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A Parquet table; only the two columns are read."""
    return spark.read.parquet(path).select(F.col(id_col).alias("doc_id"), F.lit(None).cast("string").alias("path"), F.col(text_col).alias("raw"))


#: Templates: title, what stands first, and sections with what belongs there. Long
#: enough that the audit takes none for a fragment, and all without findings in form.
SKELETONS = {
    "readme": ("Name of the project", "One sentence that says what it does and for whom.", [
        ("Install", "Give the shortest way from nothing to a running program. Name the versions it was tried with, and where to get them. Say how a reader sees that it worked.", "```sh\ninstall-command name\n```"),
        ("Use", "Show one example that a reader can copy, with what it prints. Choose the case that most readers come for. Leave the others to a page of their own and link to it.", "```sh\nname --help\n```"),
        ("Licence", "Name the licence and link to its text. If parts of the project come from others, say which parts, under what terms, and where their notices can be found here.", ""),
    ]),
    "tutorial": ("What the reader will have made", "One sentence that says what will run at the end and how long it takes.", [
        ("Before you start", "List what has to be there before the first step. Say how to check each thing, so that nobody finds out halfway through that something was missing from the start.", "- [ ] first thing that is needed\n- [ ] second thing that is needed"),
        ("Steps", "Give one action a step, in the order in which they are done. After each one, say what the reader should see, so that a mistake shows where it was made.", "1. First action\n2. Second action\n3. Third action"),
        ("Check the result", "Say how the reader can tell that all of it worked. Give one command or one view, and what it shows. Name the most common fault and its cure.", ""),
    ]),
    "reference": ("Name of the interface", "One sentence that says what it is called for and what it gives back.", [
        ("Parameters", "Give each one its type, whether it may be left out, and what then holds. State limits as numbers with units. Keep this order the same on every page of the reference.", "| Name | Type | Meaning |\n|---|---|---|\n| name | text | what it sets |"),
        ("Returns", "Say what comes back when all went well, field by field. Say which fields may be missing and when. Show one whole answer that a reader can compare with their own.", ""),
        ("Errors", "List each error with its cause and what the caller should do about it. Say which of them are worth another try, and after how long a caller should try again.", ""),
    ]),
    "adr": ("Decision in one short sentence", "Accepted on a date, by named people; it replaces nothing.", [
        ("Decision", "State what will be done, in the words of somebody who has to do it. One paragraph will do. Say from when on it holds, and for which parts of the system.", ""),
        ("Context", "Give the facts that made a decision necessary, with figures where there are any. Leave out what every reader of this record knows. Name the limits that could not be moved.", ""),
        ("Consequences", "Say what becomes easier and what becomes harder from now on. Name what has to be watched, and the sign by which the team would know that it decided wrongly.", ""),
    ]),
    "runbook": ("Name of the fault", "One sentence that says how the fault shows and how urgent it is.", [
        ("Symptoms", "Describe what is seen from outside, and the alert that fires. Give the figure above which it counts as this fault. Say what looks alike but has another cause.", ""),
        ("Steps", "Give one command a step, with what it should print. Put the step that stops the damage first, and the search for the cause last. Say when to wake somebody else.", "1. Stop the damage\n2. Find the cause\n3. Repair it"),
        ("Way back", "Say how to undo each step that changed something, in the reverse order. Name the point after which there is no way back, and who has to agree before it is passed.", ""),
    ]),
    "notes": ("Meeting on a subject", "One sentence that gives the most important thing decided, for all who read no further.", [
        ("Decisions", "Write each decision as one sentence that would be understood a year later. Say who decided it, and from when on it holds. Leave out how the talk went before it.", ""),
        ("Actions", "Give each action one owner and one date. Write what will be there when it is done, not what will be tried. Leave out actions that nobody has taken on.", "- [ ] action, owner, date"),
        ("Open questions", "List what could not be settled, and what is missing for an answer. Name the person who will bring it to the next meeting, and the date by which it has to be settled.", ""),
    ]),
}


def skeletons(spark: SparkSession, kind: str | None = None) -> DataFrame:
    """type, body: templates of six document types that audit without findings
    in their form."""

    def body(title: str, first: str, sections: list[tuple[str, str, str]]) -> str:
        spread = lambda text: ".\n\n".join(text.rsplit(". ", 1))  # noqa: E731  the last sentence stands alone
        parts = [f"## {name}\n\n{spread(text)}\n" + (f"\n{example}\n" if example else "") for name, text, example in sections]
        return f"# {title}\n\n{first}\n\n" + "\n".join(parts)

    return spark.createDataFrame([(t, body(*x)) for t, x in SKELETONS.items() if kind in (None, t)], "type string, body string")


def bundle(parts: DataFrame, demote: int = 1) -> DataFrame:
    """bundle_id, raw of parts (bundle_id, part_no, title, raw): frontmatter
    dropped, headings outside code demoted, parts joined under an H2 each, with
    a table of contents of them first."""
    raw = F.regexp_replace("raw", r"(?s)\A---\n.*?\n---\n", "")
    # fences split a text in turn into prose and code
    pieces = F.split(raw, r"(?m)^[ \t]*(?:```|~~~)")
    marked = F.transform(pieces, lambda x, i: F.when(i % 2 == 0, F.regexp_replace(x, r"(?m)^(#{1,5})(?=\s)", "$1" + "#" * demote)).otherwise(x))
    demoted = F.array_join(marked, "```")
    anchor = F.replace(F.regexp_replace(F.lower("title"), r"(?U)[^\w -]", ""), F.lit(" "), F.lit("-"))
    rows = parts.select("bundle_id", F.struct("part_no", "title", anchor.alias("anchor"), demoted.alias("text")).alias("p"))
    grouped = rows.groupBy("bundle_id").agg(F.array_sort(F.collect_list("p")).alias("p"))
    toc = F.array_join(F.transform("p", lambda x: F.concat(F.lit("- ["), x["title"], F.lit("](#"), x["anchor"], F.lit(")"))), "\n")
    text = F.array_join(F.transform("p", lambda x: F.concat(F.lit("## "), x["title"], F.lit("\n\n"), x["text"])), "\n\n")
    return grouped.select("bundle_id", F.concat(toc, F.lit("\n\n"), text).alias("raw"))

