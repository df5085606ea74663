"""One session for all tests."""

from __future__ import annotations

import os
import sys

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
for folder in (HERE, os.path.dirname(HERE)):
    if folder not in sys.path:
        sys.path.insert(0, folder)

from evalanvil.plans.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false", spark__ui__showConsoleProgress="false", spark__driver__memory="4g"
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("the test tables are absent")
    return folder
