"""Shared storage for lineage cuts and intermediate tables."""

import uuid

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT_DIR, _WAREHOUSE = "spark.checkpoint.dir", "spark.sql.warehouse.dir"


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the checkpoint folder that the session names.

    A session without that setting, as in tests, keeps its tables beside its warehouse; a cluster has to name its folder.
    """
    context = spark.sparkContext
    named = spark.conf.get(_CHECKPOINT_DIR, None) or context.getConf().get(_CHECKPOINT_DIR)
    if named:
        return named
    if context.master.startswith("local") and not context.master.startswith("local-cluster"):
        return f"{spark.conf.get(_WAREHOUSE)}/_rounds"
    raise ValueError(f"set {_CHECKPOINT_DIR} to a folder all executors share")


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new path in the session's own folder of the shared storage. That folder goes when the session's process ends."""
    own = f"{shared_dir(spark).rstrip('/')}/stallbook-{spark.sparkContext.applicationId}"
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(own)
    system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(folder):
        system.mkdirs(folder)
        system.deleteOnExit(folder)
    return f"{own}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table that several jobs read to shared storage and read it back."""
    spark = df.sparkSession
    path = fresh_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """The result of one round of an iteration as a written table.

    Lost executors then replay one round only. A written table also starts from its true size: a checkpointed
    frame keeps the estimate of its plan, which multiplies with every join of every round.
    """
    return stored(df, "round")
