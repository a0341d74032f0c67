import pytest

from voicelane.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", 4, 4)
    yield session
    session.stop()


@pytest.fixture
def one(spark):
    """Evaluate expressions on a single row: ``one(expression, name=value, ...)``."""

    def evaluate(*expressions):
        return spark.range(1).select(*expressions).first()

    return evaluate
