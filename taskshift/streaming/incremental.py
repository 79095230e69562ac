"""Occupation x AI-impact category shares, maintained incrementally."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from taskshift.plans.automation import (category_count_aggregate, classify_tasks, share_from_counts,
                                        with_category_totals)


def category_share_stream(spark: SparkSession, tasks_dir: str, tasks_schema: StructType,
                          task_statements: DataFrame, max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming frame of per-occupation category counts over all task files
    seen so far (state: one row per occupation)."""
    reader = spark.readStream.schema(tasks_schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    tasks = reader.parquet(tasks_dir)
    return category_count_aggregate(classify_tasks(tasks, task_statements))


def start_category_share(spark: SparkSession, tasks_dir: str, tasks_schema: StructType,
                         task_statements: DataFrame, out_path: str, checkpoint: str,
                         available_now: bool = False) -> StreamingQuery:
    """Start the stream; every micro-batch rewrites the share table at ``out_path``.

    ``checkpoint`` must be a folder on shared storage (the stream's offsets
    and aggregation state live there, so the query resumes after a failure).
    """
    counts = category_share_stream(spark, tasks_dir, tasks_schema, task_statements)

    def publish(batch: DataFrame, _epoch: int) -> None:
        share_from_counts(with_category_totals(batch)).write.mode("overwrite").parquet(out_path)

    w = (counts.writeStream.outputMode("complete").option("checkpointLocation", checkpoint)
         .foreachBatch(publish))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()

