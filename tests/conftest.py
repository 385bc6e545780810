import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from textloom.session import get_spark

    session = get_spark("tests", spark__sql__shuffle__partitions="4", spark__driver__memory="3g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
