import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from fleetsift.plans.session import configure
    from verification.session import local_session

    session = configure(local_session("tests"))
    session.conf.set("spark.sql.shuffle.partitions", "2")
    yield session
    session.stop()


@pytest.fixture
def make_files(spark):
    """(path, content) pairs as repo_files of scan 1."""
    def make(*pairs, scan_id=1):
        return spark.createDataFrame([("https://github.com/o/r", scan_id, p, c) for p, c in pairs],
                                     "repo_url string, scan_id bigint, path string, content string")
    return make
