import os
import sys

os.environ.setdefault("TZ", "UTC")
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import pytest

from strandline.session import build


@pytest.fixture(scope="session")
def spark():
    session = build(
        "local[8]",
        **{"spark_sql_shuffle_partitions": "8", "spark_ui_enabled": "false", "spark_driver_memory": "6g", "spark_ui_showConsoleProgress": "false", "spark_sql_warehouse_dir": "/tmp/strandline-warehouse"},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def rows():
    """Rows of a DataFrame as sorted tuples."""
    return lambda df: sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is None, str(x)) for x in r))
