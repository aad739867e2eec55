import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from flowmarrow import session

    made = session(
        "tests",
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "4g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        },
    )
    made.sparkContext.setLogLevel("OFF")
    yield made
    made.stop()


@pytest.fixture
def many_ranges(monkeypatch):
    """Take the distributed paths even for small tables."""
    from flowmarrow.operators import ordered

    monkeypatch.setattr(ordered, "ONE_RANGE", 40)
    monkeypatch.setattr(ordered, "BLOCK", 3)
    monkeypatch.setattr(ordered, "ONE_AGGREGATE", 0)
