import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from tessera.session import build_session
    s = build_session("local[4]", app_name="tessera-tests", shuffle_partitions=8,
                      extra={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="tessera-test-ckpt-")})
    yield s
    s.stop()


@pytest.fixture()
def mixed_small(spark):
    rows = [
        (1, 1.0, 10.0, "a", True),
        (2, 2.0, None, "b", False),
        (3, None, 30.0, "b", True),
        (4, 4.0, 40.0, None, None),
        (5, 5.0, 50.0, "a", False),
        (6, 6.0, 60.0, "c", True),
        (7, 7.0, 70.0, "c", True),
        (8, 100.0, 80.0, "a", False),
    ]
    return spark.createDataFrame(rows, "id long, x double, y double, k string, b boolean")
