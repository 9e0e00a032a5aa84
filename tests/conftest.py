import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
# Python workers must import test helpers (classes pickled by reference).
os.environ["PYTHONPATH"] = os.pathsep.join(
    [ROOT, os.path.join(ROOT, "tests")] + [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p])

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from lectern.session import get_spark
    s = get_spark("local[4]", app="lectern-tests", shuffle_partitions=8,
                  extra={"spark.driver.memory": "8g"})
    if not s.sparkContext.getCheckpointDir():
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lectern-test-ckpt-"))
    yield s
    s.stop()


@pytest.fixture
def scratch(spark):
    from lectern.session import scratch_path
    return scratch_path(spark, "test")
