"""Streams over stored files, run until all of them are read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from signalloom.session import new_folder

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def replayed(stream: DataFrame) -> DataFrame:
    """What a stream appends until its source is read, as a table in the shared folder, where the checkpoint lies
    too. Rows that the last watermark has not passed stay in the state."""
    spark = stream.sparkSession
    folder = new_folder(spark)
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        writer = stream.writeStream.format("parquet").outputMode("append").trigger(availableNow=True)
        query = writer.option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/rows").start()
        query.awaitTermination()
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def stream_of(spark: SparkSession, path: str) -> DataFrame:
    """The Parquet file or folder at ``path`` as a stream."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).parquet(f"{path}*")
