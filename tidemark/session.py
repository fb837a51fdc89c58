"""Session defaults, size limits and the shared scratch folder.

One setting steers how operators treat big groups. It is read from the session,
so a job can tune it without touching code:

``tidemark.rowsPerTask``
    The most rows of one series that a single task may hold. Longer series are
    cut into chunks (see ``operators.ordering``).
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

ROWS_PER_TASK = 4_000_000


def get_spark(app: str = "tidemark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators rely on (UTC, AQE, Arrow)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def rows_per_task(spark: SparkSession) -> int:
    return int(spark.conf.get("tidemark.rowsPerTask", str(ROWS_PER_TASK)))


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session.

    A cluster names it in ``spark.checkpoint.dir``. Only a local session that
    names none gets a temporary folder of its own.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
            named = tempfile.mkdtemp(prefix="tidemark-")
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path for a written table under the shared folder."""
    return f"{shared_dir(spark)}/tidemark/{uuid.uuid4().hex}/{name}"


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder, so that later reads see the same rows."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
