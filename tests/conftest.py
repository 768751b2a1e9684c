import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidewatch.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = tmp_path_factory.mktemp("shared")
    session = local_session(4, **{"spark.checkpoint.dir": str(folder)})
    yield session
    session.stop()


@pytest.fixture
def one(spark):
    """Evaluate expressions over one row of named values."""

    def run(schema, row, **columns):
        df = spark.createDataFrame([row], schema)
        return df.select(*[c.alias(n) for n, c in columns.items()]).first().asDict()

    return run
