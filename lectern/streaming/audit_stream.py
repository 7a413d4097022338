"""Audit of a document stream. The array-form operators are stateless (one row
in, one row out), so they run on a stream unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.audit import audit
from ..operators.score import score


def score_stream(spark: SparkSession, folder: str, id_col: str = "doc_id", text_col: str = "text", level: int = 2) -> DataFrame:
    """Scores of Parquet documents as they arrive in folder."""
    schema = spark.read.parquet(folder).schema
    docs = spark.readStream.schema(schema).parquet(folder)
    return score(audit(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("raw")), level))


def write_scores(scores: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Process what is there, exactly once, then stop."""
    return scores.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
