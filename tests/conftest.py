from __future__ import annotations

import os
from pathlib import Path

import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [str(Path(__file__).resolve().parents[1]), os.environ.get("PYTHONPATH")]))
    work = tmp_path_factory.mktemp("spark")
    session = (
        SparkSession.builder.master("local[4]").appName("geoloom-tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.local.dir", str(work)).config("spark.sql.warehouse.dir", str(work / "warehouse"))
        .config("spark.driver.memory", "4g").getOrCreate()
    )
    yield session
    session.stop()
