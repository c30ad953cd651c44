import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from stratiform.session import get_session

    session = get_session(
        "tests",
        "local[8]",
        spark__driver__memory="6g",
        spark__sql__shuffle__partitions="8",
        spark__ui__showConsoleProgress="false",
        spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")),
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def rows_of(df, *order):
    """Rows as tuples, in a fixed order."""
    return sorted((tuple(row) for row in df.collect()), key=lambda r: tuple((v is None, str(v)) for v in r))


def plan_of(df) -> str:
    """The final physical plan text, after adaptive execution when the query has run."""
    return df._jdf.queryExecution().executedPlan().toString()
