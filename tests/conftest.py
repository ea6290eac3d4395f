import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from canopy.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(params=["one block", "many blocks"])
def both_ways(request, monkeypatch):
    """Graphs in one block, and in so many small ones that most vertices are split."""
    if request.param == "many blocks":
        monkeypatch.setattr("canopy.operators.blocks.BLOCK", 5)
        monkeypatch.setattr("canopy.operators.blocks.HOT", 3)
        monkeypatch.setattr("canopy.operators.components.BLOCK", 3)
