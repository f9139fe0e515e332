"""Session settings the operators rely on."""

import uuid

from pyspark.sql import DataFrame, SparkSession


# Recommended settings for a new session. The last one stops PySpark from recording the call site of every column
# expression, which otherwise dominates the build time of wide plans.
RECOMMENDED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def local_session(cores: int = 8, memory: str = "12g", **extra: str) -> SparkSession:
    """A session on this machine, for tests and measurements."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("alertfold")
    settings = {
        **RECOMMENDED, "spark.sql.shuffle.partitions": str(cores), "spark.driver.memory": memory,
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", **extra,
    }
    for name, value in settings.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def pin_session(spark: SparkSession) -> SparkSession:
    """Timestamps are instants read and printed in UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, else a folder below the warehouse."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    return (shared or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/.shared").rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: what follows doesn't run it again, and a lost executor takes
    nothing with it."""
    path = f"{shared_folder(df.sparkSession)}/work/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Checkpoints go to :func:`shared_folder` unless the context has a folder already."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(spark))
