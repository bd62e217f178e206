import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from tessella.session import session

    return session("local[8]", 8, spark__sql__execution__arrow__pyspark__enabled="true")
