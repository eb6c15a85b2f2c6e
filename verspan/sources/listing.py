"""Version stores as listings: which files a version has, by name rules over a table of paths.

A listing is a DataFrame (path, modified); ``list_files`` makes one from a folder by
Spark's binaryFile source without reading contents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verspan.functions.text import semver, variant_base


def list_files(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)
    return files.select("path", F.col("modificationTime").alias("modified"), "length")


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def first_by_prefix(listing: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(version_id, path): the first file by name that begins with the version's prefix; ``prefixes``: (version_id, prefix)."""
    name = file_name(F.col("path"))
    # all beginnings of a name, so that the join is one of equals
    named = listing.select("path", name.alias("name"), F.explode(F.transform(F.sequence(F.lit(0), F.length(name)), lambda n: F.substring(name, F.lit(1), n))).alias("prefix"))
    hit = named.join(prefixes, "prefix")
    return hit.groupBy("version_id").agg(F.min_by("path", "name").alias("path"))


def highest_build(listing: DataFrame, pattern: str = r"^(.+)-build\.(\d+)\.tiny$", exclude: str = r"-(constants|unpick)") -> DataFrame:
    """(version_id, path, build): the file with the highest build number of each version."""
    name = file_name(F.col("path"))
    rows = listing.where(~name.rlike(exclude)).select("path", F.regexp_extract(name, pattern, 1).alias("version_id"), F.regexp_extract(name, pattern, 2).alias("b")).where("version_id <> ''")
    rows = rows.withColumn("build", F.col("b").cast("long"))
    return rows.groupBy("version_id").agg(F.max_by("path", F.struct("build", "path")).alias("path"), F.max("build").alias("build"))


def mapping_pairs(listing: DataFrame) -> DataFrame:
    """(version_id, paths): the combined file where there is one, else the client and server files."""
    name = file_name(F.col("path"))
    rows = listing.select("path", F.regexp_extract(name, r"^(.+?)(-client|-server)?\.txt$", 1).alias("version_id"), F.regexp_extract(name, r"(-client|-server)?\.txt$", 1).alias("side")).where("version_id <> ''")
    one = F.max(F.when(F.col("side") == "", F.col("path")))
    sides = F.sort_array(F.collect_list(F.when(F.col("side") != "", F.col("path"))))
    return rows.groupBy("version_id").agg(F.when(one.isNotNull(), F.array(one)).otherwise(sides).alias("paths"))


def preferred(sources: list[DataFrame], spellings: dict[str, str] | None = None) -> DataFrame:
    """(version_id, path) from the first source that has the version; other spellings of ids are renamed first."""
    names = F.create_map(*[F.lit(x) for kv in (spellings or {"": ""}).items() for x in kv])
    out = None
    for i, s in enumerate(sources):
        one = s.select(F.coalesce(names[F.col("version_id")], F.col("version_id")).alias("version_id"), "path", F.lit(i).alias("p"))
        out = one if out is None else out.union(one)
    return out.groupBy("version_id").agg(F.min_by("path", F.struct("p", "path")).alias("path"))


def universe(listings: list[DataFrame], resolvable: DataFrame) -> DataFrame:
    """Distinct version ids of all listings that can be resolved, in the order of their semantic versions, unknown ones last."""
    out = listings[0].select("version_id")
    for x in listings[1:]:
        out = out.union(x.select("version_id"))
    return out.distinct().join(resolvable.select("version_id").distinct(), "version_id", "left_semi").orderBy(F.asc_nulls_last(semver(F.col("version_id"))), "version_id")


def ranked(versions: DataFrame, rank: str = "sort_index") -> DataFrame:
    """The versions with their rank rewritten, and ``moved``: whether it differs from the one that was stored.

    A version that comes in the middle shifts all that follow, so all ranks are rewritten; the table is small.
    """
    now = F.row_number().over(Window.orderBy(F.asc_nulls_last(semver(F.col("version_id"))), "version_id")) - 1
    return versions.withColumn("_now", now).withColumn("moved", ~F.col(rank).eqNullSafe(F.col("_now"))).withColumn(rank, F.col("_now")).drop("_now")


def with_variants(versions: DataFrame) -> DataFrame:
    """Adds ``variant_of``: the version that a variant was made of, if that one is there as well."""
    known = versions.select(F.col("version_id").alias("_base"))
    return versions.drop("variant_of").join(known, variant_base(F.col("version_id")) == F.col("_base"), "left").withColumnRenamed("_base", "variant_of")


def resolve(versions: DataFrame, yarn: DataFrame, intermediary: DataFrame, mojmap: DataFrame) -> DataFrame:
    """Each version's sources and flags."""
    one = lambda d, c: d.select("version_id", F.col(d.columns[1]).alias(c))
    out = versions.select("version_id").join(one(yarn, "yarn"), "version_id", "left").join(one(intermediary, "intermediary"), "version_id", "left").join(one(mojmap, "mojmap"), "version_id", "left")
    return out.select("*", *[F.col(c).isNotNull().alias(f"has_{c}") for c in ("yarn", "intermediary", "mojmap")])


def changed_listing(old: DataFrame, new: DataFrame) -> DataFrame:
    """Paths that are new, or modified since."""
    return new.join(old.select("path", F.col("modified").alias("before")), "path", "left").where("before is null or before <> modified").drop("before")
