import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from lograft import session

    spark = session.local(4, shuffle_partitions=4, memory="4g")
    spark.sparkContext.setLogLevel("ERROR")
    yield spark
    spark.stop()
