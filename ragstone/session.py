"""Sessions with the settings that the engine's plans rely on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(name: str = "ragstone", master: str | None = None, **settings: str) -> SparkSession:
    """A session; keyword settings use _ for the dots of a setting's name."""
    builder = SparkSession.builder.appName(name).config(map=SETTINGS)
    if master:
        builder = builder.master(master)
    for k, v in settings.items():
        builder = builder.config(k.replace("_", "."), v)
    return builder.getOrCreate()


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share, which the cluster names in
    ``spark.checkpoint.dir``; a local session without one (a test) gets a temporary folder."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="ragstone-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: how tables of blocks (rows of some MB each) are written: a row group each, for a writer holds
#: a group, and a reader all of a group's rows, whatever their size
BLOCK_FILES = {"parquet.block.row.count.limit": "1"}


def written(df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
    """The rows of df, written to the shared folder and read again."""
    path = shared_path(df.sparkSession, name)
    df.write.options(**options or {}).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
