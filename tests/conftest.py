import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from signaldesk.runtime import prepare  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = (SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4")
         .config("spark.ui.enabled", "false").config("spark.driver.memory", "3g").getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    yield prepare(s)
    s.stop()
