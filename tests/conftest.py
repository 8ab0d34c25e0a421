import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from checks.compare import session

    s = session()
    s.conf.set("spark.sql.shuffle.partitions", "4")
    yield s
    s.stop()
