import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

from guestlens.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", app="tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture
def values(spark):
    """values(list, function): the function applied to each text of the list, in order."""
    from pyspark.sql import functions as F

    def apply(texts, function, kind="string"):
        rows = [(i, t) for i, t in enumerate(texts)]
        frame = spark.createDataFrame(rows, f"i int, t {kind}").repartition(3)
        return [r[1] for r in frame.select("i", function(F.col("t")).alias("v")).orderBy("i").collect()]

    return apply
