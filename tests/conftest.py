import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from panelspark.session import build_session

    session = build_session(
        "local[8]", 8, **{"spark.driver.memory": "6g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"}
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def day(n, start="2025-01-01"):
    import datetime as dt

    return dt.date.fromisoformat(start) + dt.timedelta(days=n)


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]
