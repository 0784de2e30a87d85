import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from spendloom.session import local_session  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "tests", spark__driver__memory="8g")
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture
def sf_dir():
    return SF_DIR


def rows(df, *order):
    """Rows as tuples, ordered for comparison."""
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]
