import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from tempolens.session import get_spark
    s = get_spark("local[4]", app="tempolens-tests", shuffle_partitions=4)
    # tests own their session: set a checkpoint folder only when none is configured
    if not s.sparkContext.getCheckpointDir() and not s.conf.get("spark.checkpoint.dir", None):
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tempolens-cp-", dir="/tmp"))
    yield s
    s.stop()
