"""Incremental ingestion: a file stream that replaces the partitions of what it delivers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verspan.shared import shared_dir


def replace_partitions(batch: DataFrame, target: str, by: str) -> None:
    """Idempotent: a version that comes again replaces its own partition only."""
    batch.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(target)


def missing(targets: DataFrame, done: DataFrame, key: str, force: bool = False) -> DataFrame:
    """Targets that are still to do."""
    return targets if force else targets.join(done.select(key), key, "left_anti")


def run_stream(source: DataFrame, target: str, checkpoint: str, by: str) -> None:
    """All available files once; the checkpoint remembers them for the next run."""
    q = source.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda b, _: replace_partitions(b, target, by)).start()
    q.awaitTermination()


def work_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/ingest-{uuid.uuid4().hex}"


def ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stream the orders into a table partitioned by year and read it back."""
    one = spark.read.parquet(f"{sf_dir}/orders.parquet")
    source = spark.readStream.schema(one.schema).option("pathGlobFilter", "orders.parquet").parquet(sf_dir).withColumn("v", F.year("o_orderdate").cast("long"))
    work = work_dir(spark)
    run_stream(source, f"{work}/orders", f"{work}/state", "v")
    return spark.read.parquet(f"{work}/orders")
