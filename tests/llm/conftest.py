import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from messy_rows import ROWS, frame  # noqa: E402


@pytest.fixture(scope="session")
def messy(spark):
    """Nulls, empty, long and repeated texts, and columns that clash with ours or differ in case only."""
    return frame(spark, ROWS)


@pytest.fixture(scope="session")
def nothing(spark):
    return frame(spark, [])
