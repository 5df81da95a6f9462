"""Session defaults and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

PARTITIONS = "spark.inkmill.input.partitions"
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: str = "8", app: str = "inkmill", **conf: str) -> SparkSession:
    """A local session for tests and measurements."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    local = {
        "spark.sql.shuffle.partitions": cores,
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "16g",
    }
    for key, value in (DEFAULTS | local | conf).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder for what is written on the way.

    A cluster names a shared folder in ``spark.checkpoint.dir``; only a local session without one
    gets a folder of its own.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="inkmill-checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def pinned(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder of the session and go on from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """``df`` as a table in the shared folder, whose size the planner knows; ``codec`` other than the session's for large texts."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    (df.write if codec is None else df.write.option("compression", codec)).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame) -> DataFrame:
    """``df`` in as many partitions as ``spark.inkmill.input.partitions`` says; as it is where that is not set.

    For tables that come in fewer files than there are cores. A large input needs no such setting.
    """
    parts = df.sparkSession.conf.get(PARTITIONS, None)
    return df if parts is None else df.repartition(int(parts))
