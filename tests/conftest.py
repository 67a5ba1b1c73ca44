import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).parent.parent), str(Path(__file__).parent)]

from helpers import SMALL  # noqa: E402

from basketlab.session import build, drop_cuts  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build(
        "tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "6g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    drop_cuts(session)
    session.stop()


@pytest.fixture(scope="session")
def ws(spark):
    from basketlab.plans.workspace import workspace

    return workspace(spark, SMALL)
