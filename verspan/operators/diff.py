"""Differences between two versions of a keyed table.

A null key never matches: its row is always added and always removed, which is what a
full join gives. Keys are shuffled once for each side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def diff_by_key(old: DataFrame, new: DataFrame, keys: list[str], name: str, both_named: bool = False) -> DataFrame:
    """(bucket, keys, old_name, new_name); ``both_named``: a rename needs a name on both sides.

    One full join, for which each side is shuffled once; a null key meets nothing there either.
    """
    a = old.select(*keys, F.col(name).alias("old_name"), F.lit(True).alias("_old"))
    b = new.select(*keys, F.col(name).alias("new_name"), F.lit(True).alias("_new"))
    differs = F.col("old_name") != F.col("new_name") if both_named else F.coalesce("old_name", F.lit("")) != F.coalesce("new_name", F.lit(""))
    bucket = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(differs, "renamed")
    return a.join(b, keys, "full").withColumn("bucket", bucket).where("bucket is not null").select("bucket", *keys, "old_name", "new_name")


def keyed_records(rows: DataFrame, parts: list[str], order: list[str]) -> DataFrame:
    """Add ``key``, the parts joined by '#'; of duplicate keys the last row by ``order`` stays."""
    w = Window.partitionBy("key").orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("key", F.concat_ws("#", *[F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts])).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def summary(diff: DataFrame, kind: str = "kind") -> DataFrame:
    """Rows for each kind and bucket, before any limit."""
    return diff.groupBy(kind, "bucket").agg(F.count("*").alias("n"))


def cut_buckets(diff: DataFrame, order: list[str], limit: int) -> DataFrame:
    """The first ``limit`` rows of each bucket, with ``truncated``: whether the bucket had more."""
    n = diff.groupBy("bucket").agg((F.count("*") > limit).alias("truncated"))
    r = F.row_number().over(Window.partitionBy("bucket").orderBy(*order))
    return diff.withColumn("pos", r).where(F.col("pos") <= limit).join(F.broadcast(n), "bucket")


def in_package(name: Column, package: str) -> Column:
    """LIKE 'package/%' without regard to ASCII case; % and _ in the package are wildcards."""
    return name.ilike(f"{package.rstrip('/')}/%")


def not_synthetic(name: Column) -> Column:
    return ~F.coalesce(F.substring_index(name, "#", -1).startswith("lambda$"), F.lit(False))


def changed_files(old: DataFrame, new: DataFrame, path: str = "path", sha: str = "sha") -> DataFrame:
    """(path, change) of files added, removed or modified, by content hash."""
    o, n = old.select(F.col(path).alias("path"), F.col(sha).alias("old_sha")), new.select(F.col(path).alias("path"), F.col(sha).alias("new_sha"))
    change = F.when(F.col("old_sha").isNull(), "added").when(F.col("new_sha").isNull(), "removed").when(F.col("old_sha") != F.col("new_sha"), "modified")
    return o.join(n, "path", "full").withColumn("change", change).where("change is not null")
