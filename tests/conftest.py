"""One local session for all tests."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from tracegrain.session import local_session, ship_package

    session = local_session("tests", "4", spark__sql__shuffle__partitions="4", spark__driver__memory="4g", spark__sql__adaptive__coalescePartitions__enabled="true")
    session.sparkContext.setLogLevel("ERROR")
    ship_package(session)
    yield session
    session.stop()
