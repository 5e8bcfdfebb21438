import pytest

from basket_engine import settings
from basket_engine.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, app="tests")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def skewed(spark):
    """No automatic broadcasts, and every key of a few rows is hot."""
    changed = {"spark.sql.autoBroadcastJoinThreshold": "-1", settings.SKEW_SLICES: "20", settings.SKEW_MIN_ROWS: "2"}
    before = {k: spark.conf.get(k, None) for k in changed}
    for key, value in changed.items():
        spark.conf.set(key, value)
    yield spark
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


@pytest.fixture(params=["planned", "skewed"])
def either(request, spark):
    """Runs a test on the planner's joins and on the balanced ones."""
    return request.getfixturevalue("skewed") if request.param == "skewed" else spark


def rows(df, *cols):
    picked = df.select(*cols) if cols else df
    return sorted((tuple(r) for r in picked.collect()), key=repr)
