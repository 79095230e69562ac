"""The incremental share table equals the batch one after all files are read."""

import os
import tempfile

from taskshift.plans import automation as A
from taskshift.sources import standin as S
from taskshift.streaming import start_category_share

SF = "/root/testdata/sf0.001"


def _rows(df):
    cols = sorted(df.columns)
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def test_stream_matches_batch(spark):
    tasks = S.tasks(spark, SF)
    stmts = S.task_statements(spark, SF)
    root = tempfile.mkdtemp(prefix="taskshift-stream-")
    src = os.path.join(root, "tasks")
    # the stand-in task table, landed as three separate file drops
    for i in range(3):
        tasks.where(tasks.task_id % 3 == i).write.parquet(os.path.join(src, f"drop={i}"))
    out = os.path.join(root, "share")
    q = start_category_share(spark, os.path.join(src, "drop=*"), tasks.schema, stmts, out,
                             os.path.join(root, "ckpt"), available_now=True)
    q.awaitTermination(300)
    streamed = spark.read.parquet(out)
    batch = A.occ_category_share(A.classify_tasks(tasks, stmts))
    assert _rows(streamed) == _rows(batch)
