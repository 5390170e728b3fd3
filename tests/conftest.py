import pytest

from tessella.session import get_session


@pytest.fixture(scope="session")
def spark():
    session = get_session(4, "tests", **{"spark.sql.shuffle.partitions": "4"})
    yield session
    session.stop()
