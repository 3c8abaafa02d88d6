"""Progress of running reviews as a stream: the last state of each lane."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from quillon.operators.summary import progress

EVENT = "run_id long, seq long, lane string, i int, total int"


def progress_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 8).json(path)


def progress_state(events: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    """Keeps a row per run and lane in an in-memory table, replaced as events come; late events of lower seq change nothing."""
    return progress(events).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).start()
