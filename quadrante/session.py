"""Session settings that the plans rely on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Adaptive execution chooses broadcast joins by measured size, splits skewed join partitions and
# merges small ones; the advisory size keeps tasks well inside executor memory.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.session.timeZone": "UTC",
}


def build_session(app_name: str = "quadrante", **extra: str) -> SparkSession:
    """A session with the settings above and ``extra`` ones, e.g.
    ``build_session("job", **{"spark.sql.shuffle.partitions": "4000"})``.

    The master, memory and parallelism come from the submit command.
    """
    builder = SparkSession.builder.appName(app_name)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """A new folder for tables that a job writes and reads again: below ``spark.checkpoint.dir``, which all machines share.

    Without that setting only a session in one process has a folder that it shares with itself.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="quadrante-")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"
