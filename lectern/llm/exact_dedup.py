"""Exact dedup: group by a 128-bit content hash, compare bytes inside groups,
keep one stable id of each group. DataFrame operations only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Guard, ascii_lower, attach, checkpointed, quoted

OUT = ("keep_id", "group_size", "kept", "text_sha256")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", digest: Callable[[Column], Column] = F.md5) -> DataFrame:
    """docs plus keep_id, group_size, kept and text_sha256.

    Texts are equal when identical after lower-casing A-Z. The first grouping
    key holds the text itself beside its 128-bit digest, so texts are told
    apart by their bytes and a digest collision never joins two groups; rows
    find their group by digest and SHA-256, and if two different texts ever
    shared both, the query fails rather than lose one of them. The digest can
    be replaced, to test collisions.

    Defined results: a null text counts as empty; texts of any length are
    compared whole; an empty table gives an empty
    table; null ids rank below all others (keep_id is null where all are null);
    of rows that repeat both id and text exactly one is kept; an input column
    named like an output is replaced.

    Shuffles: one of the texts (equal texts of a task are combined before it),
    one of digests, one of the rows with whatever columns the caller reads.
    Groups of any size are dealt over many tasks.
    """
    best = {"smallest": F.min, "largest": F.max}[keep]
    safe = Guard(docs, OUT, t=ascii_lower(F.coalesce(quoted(text_col), F.lit(""))), id=quoted(id_col))
    rows = safe.rows
    other = F.xxhash64(*[quoted(c) for c, kind in rows.dtypes if c != "__t" and "map<" not in kind and kind not in ("variant", "void")])
    rows = rows.withColumns({"__h": F.unhex(digest(F.col("__t"))), "__d": F.unhex(F.sha2("__t", 256)), "__x": other})
    texts = rows.groupBy("__h", "__d", "__t").agg(F.count(F.lit(1)).alias("n"), best("__id").alias("k"))
    groups = texts.groupBy("__h", "__d").agg(F.sum("n").alias("group_size"), best("k").alias("keep_id"), F.count(F.lit(1)).alias("texts"))
    checked = F.when(F.col("texts") == 1, F.col("group_size")).otherwise(F.raise_error(F.lit("two texts share both digests")).cast("long"))
    # kept, as three readers follow: so the texts are shuffled and compared once
    groups = checkpointed(groups.select("__h", "__d", "keep_id", checked.alias("group_size")))
    found = attach(rows.drop("__t"), groups, ["__h", "__d"], ["keep_id", "group_size"], "group_size", ["__id"])
    # attach leaves rows dealt by digest and, in hot groups, by id: so no shuffle here
    first = Window.partitionBy("__h", "__d", "__s", "__id").orderBy("__x")
    kept = F.col("__id").eqNullSafe(F.col("keep_id")) & (F.row_number().over(first) == 1)
    return safe.back(found.withColumn("kept", kept).withColumn("text_sha256", F.lower(F.hex("__d"))))
