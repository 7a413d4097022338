"""Before/after report of rewritten documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.constants import DIMENSIONS
from .audit import audit
from .score import score
from .verify import verify

FIGURES = (*DIMENSIONS, "total_hundredths", "x_deduct", "n_findings")


def report(pairs: DataFrame, level: int = 2, emoji: str = "none", scope: str = "format") -> DataFrame:
    """pair_id (unique); old_ and new_ figures of both texts; the delta of each
    dimension and of the total; what verify() found; and passes: no global
    deduction is left and nothing was lost.

    Both texts of a pair go through one audit, and their figures meet by one
    shuffle; no text is shuffled and nothing is joined.
    """
    checked = verify(pairs, scope, keep=("old", "new"))
    side = lambda name: F.struct(F.lit(name).alias("side"), F.col(name).alias("raw"))
    texts = checked.select(F.col("pair_id").alias("doc_id"), "ok", "issues", F.explode(F.array(side("old"), side("new"))).alias("t")).select("doc_id", "ok", "issues", "t.*")
    # dealt before, not by, the aggregation: else each aggregate would compute its figure anew
    scored = score(audit(texts, level, emoji), "side", "ok", "issues").repartition("doc_id")
    figures = [F.max(F.when(F.col("side") == name, F.col(c))).alias(f"{name}_{c}") for name in ("old", "new") for c in FIGURES]
    both = scored.groupBy(F.col("doc_id").alias("pair_id")).agg(*figures, F.bool_and("ok").alias("ok"), F.first("issues").alias("issues"))
    deltas = [(F.col(f"new_{c}") - F.col(f"old_{c}")).alias(f"{c}_delta") for c in (*DIMENSIONS, "total_hundredths")]
    return both.select("*", *deltas, (F.col("ok") & (F.col("new_x_deduct") == 0)).alias("passes"))
