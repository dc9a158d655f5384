import pathlib
import sys

import pytest

sys.path[:0] = [str(pathlib.Path(__file__).parents[1])]

from capledger.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[8]",
        **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "6g",
           "spark.sql.session.timeZone": "UTC"},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
