"""Queries of the difference family."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verspan.operators import diff as D
from verspan.plans.bindings import classes, lines_of, members, table
from verspan.plans.registry import query


@query("""
, a AS (SELECT * FROM classes WHERE v = 1995), b AS (SELECT * FROM classes WHERE v = 1996)
SELECT 'added' AS bucket, k, NULL AS old_name, name AS new_name FROM b WHERE k NOT IN (SELECT k FROM a)
UNION ALL SELECT 'removed', k, name, NULL FROM a WHERE k NOT IN (SELECT k FROM b)
UNION ALL SELECT 'renamed', a.k, a.name, b.name FROM a JOIN b ON a.k = b.k WHERE coalesce(a.name, '') <> coalesce(b.name, '')""")
def diff_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.diff_by_key(classes(spark, sf_dir, (1995, 1995)), classes(spark, sf_dir, (1996, 1996)), ["k"], "name")


def _null_keys(df: DataFrame) -> DataFrame:
    return df.withColumn("owner", F.when(F.col("owner") % 7 != 0, F.col("owner")))


@query("""
, m AS (SELECT v, CASE WHEN owner % 7 <> 0 THEN owner END AS owner, slot, bucket, name FROM members),
a AS (SELECT * FROM m WHERE v = 1995), b AS (SELECT * FROM m WHERE v = 1996)
SELECT 'added' AS bucket_, owner, slot, bucket, NULL AS old_name, name AS new_name FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.owner = b.owner AND a.slot = b.slot AND a.bucket = b.bucket)
UNION ALL SELECT 'removed', owner, slot, bucket, name, NULL FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE a.owner = b.owner AND a.slot = b.slot AND a.bucket = b.bucket)
UNION ALL SELECT 'renamed', a.owner, a.slot, a.bucket, a.name, b.name FROM a JOIN b ON a.owner = b.owner AND a.slot = b.slot AND a.bucket = b.bucket WHERE a.name <> b.name""")
def diff_members_null_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = lambda y: _null_keys(members(spark, sf_dir, (y, y))).withColumnRenamed("bucket", "part_bucket")
    out = D.diff_by_key(side(1995), side(1996), ["owner", "slot", "part_bucket"], "name", both_named=True)
    return out.withColumnsRenamed({"bucket": "bucket_", "part_bucket": "bucket"})


def _whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = lambda y: members(spark, sf_dir, (y, y)).withColumn("k", F.concat_ws("#", "owner", "slot", "bucket")).select("v", "k", "name")
    one = D.diff_by_key(classes(spark, sf_dir, (1995, 1995)), classes(spark, sf_dir, (1996, 1996)), ["k"], "name").withColumn("k", F.col("k").cast("string")).withColumn("kind", F.lit("class"))
    two = D.diff_by_key(m(1995), m(1996), ["k"], "name", both_named=True).withColumn("kind", F.lit("member"))
    return one.unionByName(two)


_WHOLE = """
, x AS (SELECT 'class' AS kind, v, k::VARCHAR AS k, name FROM classes UNION ALL SELECT 'member', v, owner || '#' || slot || '#' || bucket, name FROM members),
a AS (SELECT * FROM x WHERE v = 1995), b AS (SELECT * FROM x WHERE v = 1996),
d AS (SELECT kind, k, a.name AS old_name, b.name AS new_name,
  CASE WHEN a.v IS NULL THEN 'added' WHEN b.v IS NULL THEN 'removed' WHEN a.name <> b.name THEN 'renamed' END AS bucket
  FROM a FULL JOIN b USING (kind, k))
"""


@query(_WHOLE + "SELECT kind, bucket, count(*) AS n FROM d WHERE bucket IS NOT NULL GROUP BY ALL")
def diff_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.summary(_whole(spark, sf_dir))


@query(_WHOLE + """SELECT kind, k, old_name, new_name, bucket, pos, n > 50 AS truncated FROM (
  SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY kind, k) AS pos, count(*) OVER (PARTITION BY bucket) AS n FROM d WHERE bucket IS NOT NULL) WHERE pos <= 50""")
def diff_truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.cut_buckets(_whole(spark, sf_dir), ["kind", "k"], 50).withColumn("pos", F.col("pos").cast("long"))


@query("""
SELECT p_brand, count(*) AS n FROM part WHERE replace(p_name, ' ', '/') ILIKE 'SMALL/%' GROUP BY p_brand""", model=False)
def diff_package_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where(D.in_package(F.replace("p_name", F.lit(" "), F.lit("/")), "SMALL")).groupBy("p_brand").agg(F.count("*").alias("n"))


@query("""
, f AS (SELECT v, owner AS path, sha256(string_agg(slot || ':' || bucket || ':' || name, chr(10) ORDER BY slot || ':' || bucket || ':' || name)) AS sha, count(*) AS n FROM members WHERE v IN (1995, 1996) GROUP BY v, owner),
k AS (SELECT owner AS path, slot, bucket, bool_or(v = 1995) AS o, bool_or(v = 1996) AS w FROM members WHERE v IN (1995, 1996) GROUP BY ALL),
n AS (SELECT path, count(*) FILTER (w AND NOT o) AS members_added, count(*) FILTER (o AND NOT w) AS members_removed FROM k GROUP BY path)
SELECT path, CASE WHEN a.sha IS NULL THEN 'added' WHEN b.sha IS NULL THEN 'removed' ELSE 'modified' END AS change, members_added, members_removed
FROM (SELECT * FROM f WHERE v = 1995) a FULL JOIN (SELECT * FROM f WHERE v = 1996) b USING (path) JOIN n USING (path) WHERE a.sha IS DISTINCT FROM b.sha""")
def diff_files_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = members(spark, sf_dir, (1995, 1996))
    text = F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "slot", "bucket", "name"))), "\n")
    f = m.groupBy("v", F.col("owner").alias("path")).agg(F.sha2(text, 256).alias("sha"))
    k = m.groupBy(F.col("owner").alias("path"), "slot", "bucket").agg(F.bool_or(F.col("v") == 1995).alias("o"), F.bool_or(F.col("v") == 1996).alias("w"))
    n = k.groupBy("path").agg(F.count_if(F.col("w") & ~F.col("o")).alias("members_added"), F.count_if(F.col("o") & ~F.col("w")).alias("members_removed"))
    return D.changed_files(f.where("v = 1995"), f.where("v = 1996")).join(n, "path").select("path", "change", "members_added", "members_removed")


def _records(spark: SparkSession, sf_dir: str, owners) -> tuple[DataFrame, DataFrame]:
    li = lines_of(spark, sf_dir, (1995, 1996)).where(owners).select("v", "owner", "l_linenumber", "o_orderdate", "l_orderkey", F.concat("l_returnflag", "l_linestatus").alias("name"), (F.col("l_partkey") % 3).alias("bucket"))
    rec = D.keyed_records(li, ["owner", "l_linenumber", "bucket", "v"], ["o_orderdate", "l_orderkey", "name"])
    rec = rec.withColumn("key", F.concat_ws("#", "owner", "l_linenumber", "bucket")).select("v", "key", "owner", "name")
    return rec.where("v = 1995"), rec.where("v = 1996")


_RECORDS = """
, r AS (SELECT v, owner, owner || '#' || slot || '#' || bucket AS key, name FROM members WHERE v IN (1995, 1996) AND {}),
d AS (SELECT key, coalesce(a.owner, b.owner) AS owner, a.name AS old_name, b.name AS new_name, CASE WHEN a.v IS NULL THEN 'added' WHEN b.v IS NULL THEN 'removed' WHEN coalesce(a.name, '') <> coalesce(b.name, '') THEN 'renamed' END AS bucket
  FROM (SELECT * FROM r WHERE v = 1995) a FULL JOIN (SELECT * FROM r WHERE v = 1996) b USING (key))
"""


@query(_RECORDS.format("owner = 70") + "SELECT bucket, key, old_name, new_name FROM d WHERE bucket IS NOT NULL")
def diff_single_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.diff_by_key(*_records(spark, sf_dir, F.col("owner") == 70), ["key"], "name")


@query(_RECORDS.format("true") + "SELECT bucket, owner, count(*) AS n FROM d WHERE bucket IS NOT NULL GROUP BY ALL")
def diff_multi_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = D.diff_by_key(*_records(spark, sf_dir, F.lit(True)), ["key"], "name")
    return d.groupBy("bucket", F.substring_index("key", "#", 1).cast("long").alias("owner")).agg(F.count("*").alias("n"))


@query("""
, c AS (SELECT p_partkey AS k, replace(p_name, ' ', '/') || '$' || p_size AS name FROM part),
x AS (SELECT DISTINCT split_part(name, '$', 1) AS stem FROM c WHERE k % 40 = 0)
SELECT k, name FROM c WHERE split_part(name, '$', 1) IN (SELECT stem FROM x) AND NOT (split_part(name, '/', -1) LIKE 'lambda$%')""")
def changed_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose outer class is among those of changed files; no changed file gives no row."""
    from verspan.functions.text import outer_class, real_name

    c = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.concat(F.replace("p_name", F.lit(" "), F.lit("/")), F.lit("$"), "p_size").alias("name"))
    changed = c.where("k % 40 = 0").select(outer_class(F.col("name")).alias("stem")).distinct()
    return c.withColumn("stem", outer_class(F.col("name"))).join(changed, "stem", "left_semi").where(D.not_synthetic(F.substring_index("name", "/", -1))).select("k", real_name(F.col("name")).alias("name"))
