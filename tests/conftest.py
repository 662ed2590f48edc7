import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tests"))

from answerloom.session import build_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    home = tmp_path_factory.mktemp("spark")
    session = build_session("local[8]", "tests", **{
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "4g",
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.sql.warehouse.dir": str(home / "warehouse"),
    })
    session.sparkContext.setLogLevel("ERROR")
    session.sparkContext.setCheckpointDir(str(home / "shared"))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def one(spark):
    """Evaluate column expressions over one row."""
    def evaluate(*columns, **values):
        import pyspark.sql.functions as F

        df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()] or ["id"])
        row = tuple(df.select(*columns).first())
        return row[0] if len(row) == 1 else row
    return evaluate
