"""The per-row steps over streams: they keep no state, so the batch operators apply as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.evaluations import normalize, parsed
from ..operators.quality import quality_gate, quality_score


def gate_stream(records: DataFrame, purpose: str = "face") -> DataFrame:
    """Measured images with verdict, reasons and score."""
    return quality_score(quality_gate(records), purpose)


def evaluation_stream(answers: DataFrame, purpose: str = "face") -> DataFrame:
    """Raw answers (column `answer`) with the evaluation in `vl`, null where none can be read."""
    return answers.withColumn("vl", normalize(parsed(F.col("answer")), purpose))


def write_available(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends what is there now as Parquet, once for each row, and stops."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
