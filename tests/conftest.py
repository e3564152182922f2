import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from loomgraph.session import get_spark

    s = get_spark(4, "tests", spark__sql__shuffle__partitions="4")
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture
def rows():
    """Rows of a DataFrame as a sorted list of tuples."""

    def f(df, *cols):
        return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=str)

    return f
