import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from vetloom.session import local_session

    shared = tmp_path_factory.mktemp("shared")
    session = local_session(8, "vetloom-tests", **{"spark.checkpoint.dir": f"file://{shared}"})
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tables(spark):
    from vetloom.sources.tables import Tables

    return Tables(spark, "/root/testdata/sf0.001")
