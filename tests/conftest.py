import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from postingflow.session import build_session  # noqa: E402

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    ck = tempfile.mkdtemp(prefix="pf-test-ckpt-")
    s = build_session("local[*]", app="postingflow-tests", shuffle_partitions=8,
                      extra={"spark.driver.memory": "6g", "spark.checkpoint.dir": ck})
    yield s
    s.stop()


@pytest.fixture()
def tmp(tmp_path):
    return str(tmp_path)


def posting_rows(spark, rows):
    """Postings from partial dicts (missing fields null)."""
    from postingflow import schemas as S
    full = []
    for r in rows:
        full.append(tuple(r.get(f.name) for f in S.POSTING.fields))
    return spark.createDataFrame(full, S.POSTING)
