import sys
import uuid
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def jobs(spark):
    """Counts the Spark jobs a block starts."""

    class Jobs:
        def __enter__(self):
            self.group = uuid.uuid4().hex
            spark.sparkContext.setJobGroup(self.group, "counted")
            return self

        def __exit__(self, *_):
            tracker = spark.sparkContext.statusTracker()
            self.count = len(tracker.getJobIdsForGroup(self.group))
            spark.sparkContext.setJobGroup("rest", "not counted")

    return Jobs
