import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from sheafwork.session import session

    folder = tmp_path_factory.mktemp("checkpoints")
    s = session("tests", 4, **{"spark.sql.shuffle.partitions": "2", "spark.checkpoint.dir": f"file://{folder}", "spark.sql.warehouse.dir": f"file://{folder}/warehouse"})
    s.sparkContext.setCheckpointDir(f"file://{folder}")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def data():
    if not os.path.isdir(DATA):
        pytest.skip("no test tables here")
    return DATA
