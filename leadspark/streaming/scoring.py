"""Online scoring as a stream: feature rows arrive as files, banded scores leave."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from leadspark.operators.models import source_values
from leadspark.operators.scoring import accepted_requests, batch_score, rejected_requests


def read_feature_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int | None = None) -> DataFrame:
    """Feature rows from a folder of parquet files, optionally a few files at a time."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def _append(rows: DataFrame, path: str, checkpoint: str, available_now: bool) -> StreamingQuery:
    writer = rows.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()


def score_stream(
    model: PipelineModel, rows: DataFrame, out_path: str, rejected_path: str, checkpoint_path: str, available_now: bool = True
) -> tuple[StreamingQuery, StreamingQuery]:
    """Append banded scores of valid requests to one parquet table and the others with a reason to another.

    Each is written exactly once through the file sink's log. Stateless: a row's score depends on the row alone,
    so no watermark is needed. A row that cannot be scored never fails a batch.
    """
    allowed = source_values(model)
    return (
        _append(batch_score(model, accepted_requests(rows, allowed)), out_path, f"{checkpoint_path}/accepted", available_now),
        _append(rejected_requests(rows, allowed), rejected_path, f"{checkpoint_path}/rejected", available_now),
    )
