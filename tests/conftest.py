import sys
import tempfile
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark():
    with tempfile.TemporaryDirectory() as tmp:
        conf = {"spark.sql.shuffle.partitions": "4", "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g", "spark.checkpoint.dir": f"file://{tmp}", "spark.sql.warehouse.dir": f"{tmp}/warehouse"}
        s = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
        s.sparkContext.setLogLevel("ERROR")
        yield s
        s.stop()
