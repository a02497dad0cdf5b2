"""Session defaults and the lineage-cutting helper shared by the iterative jobs."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "leadweave", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every job assumes; cluster settings win where they are given."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or one of our own on a local master."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if configured is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
            configured = os.path.join(tempfile.mkdtemp(prefix="leadweave-"), "checkpoints")
        context.setCheckpointDir(configured)
    return context.getCheckpointDir()


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh subfolder of the shared folder for one job's files."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so a lost executor never replays the loop.

    The folder is the one the cluster names in ``spark.checkpoint.dir``. Only where nothing is
    configured (local runs, tests) a folder of our own is set. An eager checkpoint would compute
    ``df`` twice, and what is read back here still prunes columns.
    """
    path = work_folder(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
