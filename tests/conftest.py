import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    from skyhive.session import prepare

    session = (SparkSession.builder.master("local[*]").config("spark.sql.shuffle.partitions", "8")
               .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
               .config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    return prepare(session)
