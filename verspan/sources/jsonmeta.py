"""Version metadata in JSON files: catalog, protocol numbers, libraries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verspan.sources.listing import file_name


def canonical_id(name):
    """A manifest's version id: its file name without the 40 hexadecimal digits of its hash."""
    plain = F.regexp_replace(name, r"\.json$", "")
    id_ = F.regexp_extract(name, r"^(.+)_[0-9a-fA-F]{40}\.json$", 1)
    return F.when(id_ != "", id_).otherwise(plain)


def catalog(files: DataFrame, semvers: DataFrame | None = None) -> DataFrame:
    """(version_id, release_type, release_time, semver) of the newest manifest of each id; ``files``: (path, modified, value)."""
    rows = files.select(canonical_id(file_name(F.col("path"))).alias("version_id"), "path", "modified", F.get_json_object("value", "$.type").alias("release_type"), F.get_json_object("value", "$.releaseTime").alias("release_time"))
    newest = rows.groupBy("version_id").agg(F.max_by(F.struct("release_type", "release_time"), F.struct("modified", "path")).alias("m")).select("version_id", "m.*")
    return newest.join(semvers, "version_id", "full") if semvers is not None else newest.withColumn("semver", F.lit(None).cast("string"))


def semver_cache(files: DataFrame) -> DataFrame:
    """(version_id, semver) of JSON objects from id to version."""
    return files.select(F.explode(F.from_json("value", "map<string,string>")).alias("version_id", "semver"))


def protocol_version(files: DataFrame) -> DataFrame:
    return files.select("path", F.get_json_object("value", "$.protocol_version").cast("int").alias("protocol_version"))


def libraries(files: DataFrame, present: DataFrame) -> DataFrame:
    """(path, library): base names of a manifest's library artifacts that are among the present files."""
    schema = "struct<libraries: array<struct<downloads: struct<artifact: struct<path: string>>>>>"
    lib = files.select("path", F.explode(F.from_json("value", schema)["libraries"]).alias("l"))
    lib = lib.select("path", file_name(F.col("l.downloads.artifact.path")).alias("library")).where("library is not null")
    return lib.join(present.select(file_name(F.col("path")).alias("library")).distinct(), "library", "left_semi").select("path", "library").distinct()
