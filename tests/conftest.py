import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from tessera.session import build_session
    s = build_session(master="local[4]", shuffle_partitions=4)
    yield s
    s.stop()


def one_col(spark, values, col_type="string"):
    """Small frame (id, v) from literals, ids in list order."""
    return spark.createDataFrame(list(enumerate(values)), f"id long, v {col_type}")
