import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from stratocast.session import get_spark  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"

# many buckets of the prefix operator on tiny data
BUCKETED = {"rows_per_bucket": 7}


@pytest.fixture(scope="session")
def spark():
    s = get_spark("stratocast-tests", master="local[4]", shuffle_partitions=4)
    yield s
    s.stop()
