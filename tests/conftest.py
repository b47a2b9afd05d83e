import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from statelake.session import build_session, ship_package

    session = build_session("tests", "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false"})
    ship_package(session)
    yield session
    session.stop()


@pytest.fixture()
def root(tmp_path):
    return f"file://{tmp_path}"
