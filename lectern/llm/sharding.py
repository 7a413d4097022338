"""Sharding: rendezvous (highest random weight) hashing of record keys over
weighted shards, with gapless slots. DataFrame operations only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Guard, quoted

OUT = ("shard", "slot", "grown_shard")
#: Rows that one task numbers, about.
SLOT_ROWS = 20_000


def rendezvous(key: Column, weights: list[float]) -> Column:
    """The shard whose score ln(u) / weight is largest; u in (0, 1) is a hash of
    key and shard. A new shard changes no other score, so it only takes rows."""

    def score(i: int, w: float) -> Column:
        bits = F.substring(F.md5(F.concat(key, F.lit(f":{i}"))), 1, 13)
        u = (F.conv(bits, 16, 10).cast("double") + 0.5) / float(2**52)
        return F.struct((F.log(u) / w).alias("s"), F.lit(-i).alias("i"))

    live = [score(i, w) for i, w in enumerate(weights) if w > 0]
    if not live:
        raise ValueError("no shard has a positive weight")
    return (-F.array_max(F.array(*live))["i"]).cast("int")


def shard(docs: DataFrame, weights: list[float], grown: list[float] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs plus shard, slot (0, 1, ... in each shard, in an order that only
    depends on the rows) and grown_shard (under the weights grown, else null).

    Slots need no task per shard: rows fall into buckets by a prefix of their
    order key, buckets are counted, and each bucket is numbered by itself.
    Buckets grow in number with the table, so a shard of any size is spread.

    Defined results: a null id is a key of its own (""), so all such rows share
    a shard; repeated ids share a shard and get different slots; texts take part
    only in the order; an empty table gives an empty table; an input column
    named like an output is replaced.
    """
    key, text = F.coalesce(quoted(id_col).cast("string"), F.lit("")), F.coalesce(quoted(text_col), F.lit(""))
    order = F.md5(F.concat(key, F.lit("|"), F.crc32(F.encode(text, "UTF-8")).cast("string")))
    safe = Guard(docs, OUT, key=key, o=order, x=F.md5(text))
    digits = max(1, math.ceil(math.log(max(1, docs.count() / (SLOT_ROWS * len(weights))), 16)))
    key = F.col("__key")
    rows = safe.rows.withColumns({"shard": rendezvous(key, weights), "grown_shard": rendezvous(key, grown) if grown else F.lit(None).cast("int"), "__b": F.substring("__o", 1, digits)})
    ahead = Window.partitionBy("shard").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("shard", "__b").agg(F.count(F.lit(1)).alias("__n"))
    starts = counts.select("shard", "__b", F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__start"))
    within = Window.partitionBy("shard", "__b").orderBy("__o", "__key", "__x")
    rows = rows.withColumn("__r", F.row_number().over(within)).join(starts, ["shard", "__b"])
    return safe.back(rows.withColumn("slot", F.col("__start") + F.col("__r") - 1))
