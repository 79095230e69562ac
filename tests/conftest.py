import os
import sys
import tempfile

import pytest

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, REPO)


@pytest.fixture(scope="session")
def spark():
    from taskshift.session import get_session
    s = get_session("local[4]", shuffle_partitions=4)
    # tests only: use a fresh scratch checkpoint folder when none is configured
    if not s.conf.get("spark.checkpoint.dir", None):
        s.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="taskshift-test-ckpt-"))
    yield s
    s.stop()


def rows(df, order=None):
    """Collect as a sorted list of plain tuples (column order as in df)."""
    out = [tuple(r) for r in df.collect()]
    return sorted(out, key=repr)
