import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tools"))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from evolve.session import get_spark
    warehouse = tempfile.mkdtemp(prefix="evolve-wh-")
    s = get_spark(master="local[4]", shuffle_partitions=4,
                  extra={"spark.sql.warehouse.dir": warehouse,
                         "spark.driver.extraJavaOptions": f"-Dderby.system.home={warehouse}"})
    yield s
    s.stop()


@pytest.fixture()
def tmpdir_path():
    return tempfile.mkdtemp(prefix="evolve-test-")
