"""Session defaults and the one place that decides where cut lineage is stored."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(app: str = "rulegrain", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def cut_lineage(df: DataFrame, reader: SparkSession | None = None) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back, by its own session or by ``reader``.

    The folder comes from ``spark.checkpoint.dir`` (shared storage on a cluster), so the result survives lost executors. Rows are
    stored as compressed columns: readers take only the columns they use.
    """
    path = f"{shared_folder(df.sparkSession, 'stage')}/rows"
    df.write.option("compression", "zstd").parquet(path)
    return (reader or df.sparkSession).read.schema(df.schema).parquet(path)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the shared checkpoint directory, or a local one in local mode."""
    base = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder before running this operator")
        return tempfile.mkdtemp(prefix=f"rulegrain-{name}-")
    return f"{base.rstrip('/')}/{name}-{os.urandom(6).hex()}"
