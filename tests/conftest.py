import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from checks.compare import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session("8", "tests")


@pytest.fixture(autouse=True)
def clear_cache(spark):
    yield
    spark.catalog.clearCache()
