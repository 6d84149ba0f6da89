import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from scorecast.session import build_session, clean_scratch, scratch_dir

    s = build_session("local[4]", app="scorecast-tests", shuffle_partitions=8)
    scratch_dir(s)  # a local session without spark.checkpoint.dir gets a private folder
    yield s
    clean_scratch(s)
    s.stop()


@pytest.fixture(scope="session")
def tables(spark):
    from scorecast.sources.tables import Tables

    return Tables.for_dir(spark, SF_SMALL)
