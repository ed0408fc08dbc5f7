"""Lineage cut through reliable storage, so that a lost executor does not change what was already placed."""
import uuid

from pyspark.sql import DataFrame, SparkSession


def _shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a session that does not set it uses a folder of its warehouse, which its executors share too."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints")
    return context._jsc.sc().getCheckpointDir().get()


def cut_lineage(df: DataFrame) -> DataFrame:
    """df, stored as it is partitioned."""
    _shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored_columns(df: DataFrame) -> DataFrame:
    """df, stored as Parquet: for wide frames that several plans read a few columns of. Its partitioning is lost."""
    path = f"{_shared_folder(df.sparkSession)}/columns-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
