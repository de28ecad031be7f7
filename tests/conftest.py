import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from weftline.session import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    top = tmp_path_factory.mktemp("shared")
    session = local_session(4, 4, **{"spark.checkpoint.dir": f"file://{top}/checkpoints", "spark.sql.warehouse.dir": f"{top}/warehouse", "spark.driver.memory": "4g"})
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    return SMALL
