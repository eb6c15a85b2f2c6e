"""The folder that the driver and all executors share."""

from __future__ import annotations

import hashlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """As ``spark.checkpoint.dir`` names it; a temporary folder only where all runs on one machine."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='verspan-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def ready(spark: SparkSession) -> None:
    """Lets DataFrames be checkpointed to the shared folder."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))


def derived(spark: SparkSession, name: str, *sources: str) -> str:
    """A place for what is derived from source files: another one if any of them is written anew."""
    jvm, conf, told = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), hashlib.sha256()
    for source in sources:
        path = jvm.org.apache.hadoop.fs.Path(source)
        files, each = [], path.getFileSystem(conf).listFiles(path, True)
        while each.hasNext():
            f = each.next()
            files.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
        told.update("\n".join(sorted(files)).encode())
    return f"{shared_dir(spark)}/{name}-{told.hexdigest()[:32]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read again: its work is done once and its lineage ends."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
