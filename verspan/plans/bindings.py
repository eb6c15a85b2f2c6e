"""The versioned symbol model bound to the provided tables.

version: order year; class: a customer's orders of a year, named by the priority of
the latest one; member: line number of a customer's orders of a year, named by the
flags of the latest such line, described by its part's bucket.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders(spark: SparkSession, sf_dir: str, years: tuple[int, int] | None = None) -> DataFrame:
    """Orders with their version; years: the first and last one, as a range of dates that the scan can skip by."""
    o = table(spark, sf_dir, "orders")
    if years:
        o = o.where((F.col("o_orderdate") >= F.lit(f"{years[0]}-01-01").cast("timestamp_ntz")) & (F.col("o_orderdate") < F.lit(f"{years[1] + 1}-01-01").cast("timestamp_ntz")))
    return o.withColumn("v", F.year("o_orderdate").cast("long"))


def classes(spark: SparkSession, sf_dir: str, years: tuple[int, int] | None = None) -> DataFrame:
    """(v, k, name)"""
    return orders(spark, sf_dir, years).groupBy("v", F.col("o_custkey").alias("k")).agg(F.max_by("o_orderpriority", F.struct("o_orderdate", "o_orderkey")).alias("name"))


def lines_of(spark: SparkSession, sf_dir: str, years: tuple[int, int] | None = None) -> DataFrame:
    """Lines with the year and customer of their order."""
    o = orders(spark, sf_dir, years).select("o_orderkey", "v", F.col("o_custkey").alias("owner"), "o_orderdate")
    return table(spark, sf_dir, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"))


#: Lines of a task where all lines are grouped: what a task holds stays the same at any size of the input.
LINES_AT_ONCE = 500_000


def tasks_for(spark: SparkSession, sf_dir: str) -> int:
    """Tasks that the lines are dealt out to, from the number of rows in the files' footers."""
    return max(1, -(-table(spark, sf_dir, "lineitem").count() // LINES_AT_ONCE))


def part_lines(spark: SparkSession, sf_dir: str, tasks: int, outer: bool = False) -> DataFrame:
    """(part, sup, v) of the lines, joined in ``tasks`` tasks; outer: also of lines without an order, v is null."""
    o = orders(spark, sf_dir).select(F.col("o_orderkey").alias("l_orderkey"), "v").repartition(tasks, "l_orderkey")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("sup")).repartition(tasks, "l_orderkey")
    return li.join(o.hint("merge"), "l_orderkey", "left" if outer else "inner").select("part", "sup", "v")


def members(spark: SparkSession, sf_dir: str, years: tuple[int, int] | None = None) -> DataFrame:
    """(v, owner, slot, bucket, name)"""
    keys = ["v", "owner", F.col("l_linenumber").cast("long").alias("slot"), (F.col("l_partkey") % 3).alias("bucket")]
    return lines_of(spark, sf_dir, years).groupBy(*keys).agg(F.max_by(F.concat("l_returnflag", "l_linestatus"), F.struct("o_orderdate", "l_orderkey", F.concat("l_returnflag", "l_linestatus"))).alias("name"))


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(v, rank, is_release): odd years are releases."""
    v = orders(spark, sf_dir).select("v").distinct()
    return v.select("v", (F.col("v") - 1995).alias("rank"), (F.col("v") % 2 == 1).alias("is_release"))


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(owner, ref_owner, cnt): part referred to by supplier."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_partkey").alias("owner"), F.col("l_suppkey").alias("ref_owner")).agg(F.count("*").alias("cnt"))


def hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(parent, child) names: region R, nation N, customer C."""
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("R"), "n_regionkey").alias("parent"), F.concat(F.lit("N"), "n_nationkey").alias("child"))
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("N"), "c_nationkey").alias("parent"), F.concat(F.lit("C"), "c_custkey").alias("child"))
    return n.union(c)


#: The same model for DuckDB, as common table expressions.
MODEL = """
o AS (SELECT year(o_orderdate)::BIGINT AS v, * FROM orders),
classes AS (SELECT v, o_custkey AS k, arg_max(o_orderpriority, row(o_orderdate, o_orderkey)) AS name FROM o GROUP BY v, o_custkey),
lines AS (SELECT l.*, o.v, o.o_custkey AS owner, o.o_orderdate FROM lineitem l JOIN o ON l_orderkey = o_orderkey),
members AS (SELECT v, owner, l_linenumber::BIGINT AS slot, l_partkey % 3 AS bucket, arg_max(l_returnflag || l_linestatus, row(o_orderdate, l_orderkey, l_returnflag || l_linestatus)) AS name FROM lines GROUP BY ALL),
versions AS (SELECT DISTINCT v, v - 1995 AS rank, v % 2 = 1 AS is_release FROM o),
refs AS (SELECT l_partkey AS owner, l_suppkey AS ref_owner, count(*) AS cnt FROM lineitem GROUP BY ALL),
tree AS (SELECT 'R' || n_regionkey AS parent, 'N' || n_nationkey AS child FROM nation UNION ALL SELECT 'N' || c_nationkey, 'C' || c_custkey FROM customer)
"""
