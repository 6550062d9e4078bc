from __future__ import annotations

import logging

import pytest
from pyspark.sql import SparkSession

from crashmart.session import tune


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    logging.getLogger("DataFrameQueryContextLogger").disabled = True
    session = (SparkSession.builder.master("local[8]").appName("tests").config("spark.ui.enabled", "false").config("spark.python.sql.dataFrameDebugging.enabled", "false")
               .config("spark.sql.shuffle.partitions", "2")
               .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("scratch"))).getOrCreate())
    session.sparkContext.setLogLevel("OFF")
    yield tune(session)
    session.stop()
