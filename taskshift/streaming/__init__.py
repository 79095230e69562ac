"""Incremental (Structured Streaming) form of the task-level steps.

The analysed scripts are batch only; nothing here adds an operator. New task
rating files landing in a folder are classified with the same
``classify_tasks`` code as the batch path (a stream-static left join to the
task statements), their per-occupation category counts are kept as
streaming aggregation state, and each micro-batch publishes the current
occupation x category share table through ``foreachBatch`` using the same
``share_from_counts`` code as the batch result.
"""

from taskshift.streaming.incremental import category_share_stream, start_category_share  # noqa: F401
