"""Helpers that several operators share: text normalising, column hygiene,
skew-safe lookups and the shared checkpoint folder."""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: A run of characters other than space, tab, line feed, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"
#: A key counts as hot from this share of all rows on, so that at most
#: 1 / HOT_SHARE keys are hot: the proven bound on what attach() broadcasts.
HOT_KEYS = 1024
#: Rows of one or two numbers that may be broadcast: 16 MB.
BROADCAST_ROWS = 1 << 20


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII text takes the fast built-in path."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def without(df: DataFrame, *names: str) -> DataFrame:
    """df less the columns an operator is about to write (any letter case)."""
    taken = {n.lower() for n in names}
    return df.select([quoted(c) for c in df.columns if c.lower() not in taken])


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def unused(name: str, df: DataFrame) -> str:
    """A column name like name that df doesn't have, in any letter case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


class Guard:
    """Keeps an operator's own columns, which begin with two underscores, apart
    from input columns that do so too: those get other names while it works."""

    def __init__(self, df: DataFrame, written: tuple[str, ...], **own: Column):
        """rows: df less the columns that are about to be written, plus own."""
        kept = without(df, *written).columns
        self.names = {c: f"__{i}_" if c.startswith("__") else c for i, c in enumerate(kept)}
        self.rows = df.select(*[quoted(c).alias(n) for c, n in self.names.items()], *[c.alias(f"__{n}") for n, c in own.items()])
        self.written = written

    def back(self, df: DataFrame) -> DataFrame:
        """df with the input's columns under their names, and the written ones."""
        return df.select(*[quoted(n).alias(c) for c, n in self.names.items()], *self.written)


def use_shared_checkpoints(spark: SparkSession) -> str:
    """The folder for checkpoints: spark.checkpoint.dir. Where that is unset, a
    single-JVM session (tests) gets a temporary folder; on a cluster executors
    couldn't read one, so that is an error."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        given = spark.conf.get("spark.checkpoint.dir", None)
        if not given and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(given or tempfile.mkdtemp(prefix="lectern-checkpoints-"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the folder all executors share."""
    use_shared_checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Has the driver collect its garbage: until then Spark keeps the shuffle
    files and checkpoints of plans that nothing refers to any more."""
    gc.collect()
    spark._jvm.System.gc()


def small_side(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df (checkpointed, a few numbers a row), marked for a broadcast if it is
    counted to have at most that many rows, else as it is."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def attach(rows: DataFrame, groups: DataFrame, keys: list[str], values: list[str], count: str, spread: list[str]) -> DataFrame:
    """Left-join values of groups (one row per keys, keys never null) to rows,
    with no task holding a hot key.

    Groups with at least 1/1024 of all grouped rows can be at most 1024: they
    are broadcast, a size that does not grow with the data. Their rows then
    carry a spread key that matches nothing, so the shuffle join for the other
    groups deals them out evenly. count names groups' row count; spread names
    columns of rows that differ within a hot key.
    """
    total = groups.agg(F.coalesce(F.sum(count), F.lit(0)).alias("total")).scalar()
    packed = groups.select(*keys, F.col(count).alias("__n"), F.struct(*values).alias("__v"))
    is_hot = F.col("__n") * HOT_KEYS >= total
    hot = packed.where(is_hot).select(*keys, F.col("__v").alias("__hot"))
    # 0, but not a literal: a constant would be folded into the join condition,
    # and rows would be dealt by keys alone
    zero = F.when(F.col("__n") < 0, 1).otherwise(0).cast("long")
    cold = packed.where(~is_hot).select(*keys, zero.alias("__s"), F.col("__v").alias("__cold"))
    out = (
        rows.join(F.broadcast(hot), keys, "left")
        .withColumn("__s", F.when(F.col("__hot").isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64(*spread).bitwiseOR(F.lit(1).cast("long"))))
        .join(cold, [*keys, "__s"], "left")
    )
    both = F.coalesce("__hot", "__cold")
    return out.withColumns({v: both[v] for v in values}).drop("__hot", "__cold")
