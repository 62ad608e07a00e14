"""Session for tests and benchmarks; on a cluster use the session the cluster gives."""

import atexit
import os
import shutil
import tempfile

from pyspark.sql import SparkSession


def local_session(cores: str | int = "*", partitions: int = 8, name: str = "bondmarts", checkpoint: str | None = None) -> SparkSession:
    """`checkpoint` is the folder of written intermediate tables; without it a temporary one, deleted at exit."""
    if checkpoint is None:
        checkpoint = tempfile.mkdtemp(prefix="bondmarts-")
        atexit.register(shutil.rmtree, checkpoint, ignore_errors=True)
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", os.environ.get("BONDMARTS_DRIVER_MEMORY", "8g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", checkpoint)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
