import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from candex.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, partitions=4, memory="8g")
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture()
def hot(spark):
    """Limits so low that ordinary groups take the paths for groups too large for one task."""
    values = {"checkBytes": "0", "groupRows": "3", "foldRows": "3"}
    for name, value in values.items():
        spark.conf.set(f"spark.candex.{name}", value)
    yield spark
    for name in values:
        spark.conf.unset(f"spark.candex.{name}")
