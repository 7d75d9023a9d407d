import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from lumentrace.session import build_session

    session = build_session(
        "local[8]",
        app="lumentrace-tests",
        spark__sql__shuffle__partitions="4",
        spark__driver__memory="8g",
        spark__ui__enabled="false",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")),
        spark__ui__showConsoleProgress="false",
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def movie():
    """Two recordings of 6 x 5 pixels and 20 frames, as an array [measu, x, y, t]."""
    import numpy as np

    return np.random.default_rng(7).normal(100, 10, (2, 6, 5, 20))


@pytest.fixture(scope="session")
def traces(spark, movie):
    from lumentrace.model import TRACES

    rows = [(m, x, y, movie[m, x, y].tolist()) for m in range(2) for x in range(6) for y in range(5)]
    return spark.createDataFrame(rows, TRACES).repartition(3)


def dense(df, shape, value="v"):
    """A long table as an array in the order of `shape`'s keys."""
    import numpy as np

    out = np.full(shape, np.nan)
    for row in df.collect():
        out[row["measu"], row["x"], row["y"], row["t"]] = row[value]
    return out


@pytest.fixture(scope="session")
def to_array():
    return dense
