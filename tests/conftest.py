import sys
from pathlib import Path

import pandas as pd
import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[8]").config("spark.driver.memory", "6g").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for p in sorted(Path(SMALL).glob("*.parquet")):
        c.sql(f"create view {p.stem} as select * from '{p}'")
    return c


def rows_of(frame) -> list[str]:
    """Rows as text, whatever engine made them: order-free, whole numbers alike."""
    columns = sorted(frame.columns)

    def plain(x):
        if x is None or x is pd.NA or x != x:
            return None
        x = x.item() if hasattr(x, "item") else x
        return int(x) if isinstance(x, float) and x.is_integer() else x

    return sorted(str([plain(x) for x in r]) for r in frame[columns].astype(object).values.tolist())
