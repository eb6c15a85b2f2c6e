"""The engine's own methods over symbol tables bound to orders and lineitem.

A version is a year; a class a customer with orders in it, named in four namespaces, the
named one moving with the priority of the latest order; a member a line number and part
bucket of the customer's orders, methods two buckets, fields the third.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verspan import schema
from verspan.engine import Engine
from verspan.plans.bindings import classes, lines_of, members, versions
from verspan.plans.registry import query
from verspan.shared import derived


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    v = versions(spark, sf_dir).select(F.col("v").cast("string").alias("version_id"), F.when(F.col("is_release"), "release").otherwise("snapshot").alias("release_type"), F.col("rank").cast("int").alias("sort_index"))
    rest = [F.lit(None).cast("string").alias("release_time"), F.lit(None).cast("int").alias("protocol_version"), F.lit("now").alias("indexed_at"), *[F.lit(True).alias(f"has_{n}") for n in ("yarn", "mojmap", "intermediary")], F.lit(None).cast("string").alias("variant_of"), *[F.lit(None).cast("bigint").alias(f"{n}_count") for n in ("class", "method", "field")]]
    k = F.col("k").cast("string")
    named = F.concat(F.lit("y/p"), F.substring("name", 1, 1), F.lit("/C"), k)
    c = classes(spark, sf_dir).select(
        F.col("v").cast("string").alias("version_id"), F.col("k").alias("class_id"), F.concat(F.lit("o"), k).alias("obf_name"), F.concat(F.lit("i/c_"), k).alias("intermediary_name"), named.alias("yarn_name"),
        F.concat(F.lit("m/C"), k).alias("mojmap_name"), F.concat(F.lit("y/p"), F.substring("name", 1, 1)).alias("package_path"), F.concat(F.lit("C"), k).alias("simple_name"), F.lit("both").alias("presence"))
    slot, owner = F.col("slot").cast("string"), F.col("owner").cast("string")
    desc = lambda t: F.when(F.col("bucket") == 0, F.concat(F.lit("(L"), F.lit(t), owner, F.lit(";)V"))).when(F.col("bucket") == 1, "()V").otherwise("I")
    m = members(spark, sf_dir).select(
        F.col("v").cast("string").alias("version_id"), F.when(F.col("bucket") < 2, "method").otherwise("field").alias("kind"), (F.col("owner") * 100 + F.col("slot") * 10 + F.col("bucket")).alias("member_id"), F.col("owner").alias("class_id"),
        F.concat(F.lit("a"), slot).alias("obf_name"), desc("o").alias("obf_desc"), F.concat(F.lit("m_"), slot, F.lit("_"), F.col("bucket").cast("string")).alias("intermediary_name"), desc("i/c_").alias("intermediary_desc"), desc("i/c_").alias("stable_desc"),
        F.concat(F.lower("name"), slot).alias("yarn_name"), F.concat(F.lit("n"), slot).alias("mojmap_name"), F.concat(F.lower("name"), slot).alias("simple_name"))
    r = lines_of(spark, sf_dir).groupBy(F.col("v").cast("string").alias("version_id"), (F.col("l_partkey") % 50).alias("p"), (F.col("l_partkey") % 7).alias("q"), F.col("owner").alias("o"), F.col("l_linenumber").alias("n")).agg(F.count("*").cast("int").alias("cnt"))
    r = r.select("version_id", F.lit("mojmap").alias("ns"), F.concat(F.lit("t/T"), F.col("p").cast("string")).alias("owner"), F.concat(F.lit("f"), F.col("q").cast("string"), F.lit(":()V")).alias("member"), F.concat(F.lit("m/C"), F.col("o").cast("string")).alias("ref_owner"), F.concat(F.lit("n"), F.col("n").cast("string")).alias("ref_member"), F.lit("()V").alias("ref_descriptor"), F.lit("call").alias("ref_kind"), F.lit(None).cast("string").alias("ref_synthetic"), "cnt")
    methods = F.transform(F.sort_array(F.collect_set("slot")), lambda s: F.struct(F.concat(F.lit("n"), s.cast("string")).alias("name"), F.lit("()V").alias("descriptor")))
    d = members(spark, sf_dir).groupBy("v", "owner").agg(methods.alias("members"))
    d = d.select(F.col("v").cast("string").alias("version_id"), F.lit("mojmap").alias("ns"), F.concat(F.lit("m/C"), F.col("owner").cast("string")).alias("owner"), F.lit(1).alias("access"), F.when(F.col("owner") % 10 != 0, F.array(F.concat(F.lit("m/C"), F.floor(F.col("owner") / 10).cast("string")))).otherwise(F.array().cast("array<string>")).alias("supertypes"), F.array().cast("array<string>").alias("subtypes"), "members")
    names = [f.split()[0] for f in schema.VERSIONS.split(", ")]
    return Engine(spark, v.select("*", *rest).select(*names), c, m, d, r)


#: The same tables for DuckDB.
_E = """
, cl AS (SELECT v::VARCHAR AS version_id, k AS class_id, 'o' || k AS obf_name, 'i/c_' || k AS intermediary_name, 'y/p' || name[1:1] || '/C' || k AS yarn_name, 'm/C' || k AS mojmap_name, 'C' || k AS simple_name, 'y/p' || name[1:1] AS package_path FROM classes),
me AS (SELECT v::VARCHAR AS version_id, CASE WHEN bucket < 2 THEN 'method' ELSE 'field' END AS kind, owner * 100 + slot * 10 + bucket AS member_id, owner AS class_id, 'a' || slot AS obf_name,
  CASE bucket WHEN 0 THEN '(Lo' || owner || ';)V' WHEN 1 THEN '()V' ELSE 'I' END AS obf_desc, CASE bucket WHEN 0 THEN '(Li/c_' || owner || ';)V' WHEN 1 THEN '()V' ELSE 'I' END AS stable_desc, 'm_' || slot || '_' || bucket AS intermediary_name, lower(name) || slot AS yarn_name, 'n' || slot AS mojmap_name FROM members),
rf AS (SELECT v::VARCHAR AS version_id, 't/T' || l_partkey % 50 AS owner, 'f' || l_partkey % 7 || ':()V' AS member, 'm/C' || owner AS ref_owner, 'n' || l_linenumber AS ref_member, count(*)::INTEGER AS cnt FROM lines GROUP BY v, l_partkey % 50, l_partkey % 7, owner, l_linenumber),
de AS (SELECT v::VARCHAR AS version_id, 'm/C' || owner AS owner, CASE WHEN owner % 10 <> 0 THEN 'm/C' || owner // 10 END AS parent, list_sort(list(DISTINCT slot)) AS slots FROM members GROUP BY v, owner)
"""


@query(_E + """, n AS (SELECT version_id, count(*) AS class_count FROM cl GROUP BY 1), k AS (SELECT version_id, count(*) FILTER (kind = 'method') AS method_count, count(*) FILTER (kind = 'field') AS field_count FROM me GROUP BY 1)
SELECT v::VARCHAR AS version_id, rank::INTEGER AS rank, CASE WHEN is_release THEN 'release' ELSE 'snapshot' END AS release_type, class_count, coalesce(method_count, 0) AS method_count, coalesce(field_count, 0) AS field_count FROM versions LEFT JOIN n ON n.version_id = v::VARCHAR LEFT JOIN k ON k.version_id = v::VARCHAR""")
def engine_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).list_versions().select("version_id", F.col("sort_index").alias("rank"), "release_type", "class_count", "method_count", "field_count")


@query(_E + """
, a AS (SELECT * FROM cl WHERE version_id = '1995'), b AS (SELECT * FROM cl WHERE version_id = '1996'),
x AS (SELECT me.version_id, kind, cl.intermediary_name || '#' || me.intermediary_name || stable_desc AS key, me.yarn_name AS name, cl.yarn_name AS owner FROM me JOIN cl USING (version_id, class_id)),
ma AS (SELECT * FROM x WHERE version_id = '1995'), mb AS (SELECT * FROM x WHERE version_id = '1996'),
d AS (SELECT 'class' AS kind, intermediary_name AS key, a.yarn_name AS old_name, b.yarn_name AS new_name, coalesce(b.yarn_name, a.yarn_name) AS owner, a.version_id AS o, b.version_id AS n FROM a FULL JOIN b USING (intermediary_name)
  UNION ALL SELECT kind, key, ma.name, mb.name, coalesce(mb.owner, ma.owner), ma.version_id, mb.version_id FROM ma FULL JOIN mb USING (kind, key))
SELECT CASE WHEN o IS NULL THEN 'added' WHEN n IS NULL THEN 'removed' ELSE 'renamed' END AS bucket, kind, key, old_name, new_name, owner FROM d WHERE o IS NULL OR n IS NULL OR old_name <> new_name""")
def engine_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All differences of two versions: classes, methods and fields by their identities."""
    return engine(spark, sf_dir).diff_all("1995", "1996").select("bucket", "kind", "key", "old_name", "new_name", "owner")


@query(_E + """
, q AS (SELECT unnest([7, 11, 100]) AS k), g AS (SELECT 'm/C' || k AS query, v.v, v.rank, c.intermediary_name AS im, c.yarn_name, c.mojmap_name FROM q, versions v LEFT JOIN cl c ON c.version_id = v.v::VARCHAR AND c.class_id = k),
m AS (SELECT *, CASE WHEN lag(1) OVER w IS NULL OR (im IS NULL) <> (lag(im) OVER w IS NULL) OR yarn_name IS DISTINCT FROM lag(yarn_name) OVER w THEN 1 ELSE 0 END AS new FROM g WINDOW w AS (PARTITION BY query ORDER BY rank)),
i AS (SELECT *, sum(new) OVER (PARTITION BY query ORDER BY rank) AS island FROM m)
SELECT query, im IS NOT NULL AS present, im AS intermediary_name, yarn_name, mojmap_name, min(v)::VARCHAR AS "from", max(v)::VARCHAR AS "to", count(*) AS versions FROM i WHERE query IN (SELECT mojmap_name FROM cl) GROUP BY query, island, im, yarn_name, mojmap_name""")
def engine_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of some classes that were asked for, followed over their moves."""
    e = engine(spark, sf_dir)
    asked = [f"m/C{k}" for k in (7, 11, 100)]
    found = e.classes.where(F.col("mojmap_name").isin(asked)).select(F.col("mojmap_name").alias("query")).distinct()
    out = None
    for q in asked:
        one = e.history(q)
        out = one if out is None else out.unionByName(one)
    return out.join(found, "query", "left_semi").select("query", "present", "intermediary_name", "yarn_name", "mojmap_name", "from", "to", "versions")


@query(_E + """
, c6 AS (SELECT * FROM cl WHERE version_id = '1996'), m6 AS (SELECT me.*, cl.yarn_name AS y, cl.mojmap_name AS z FROM me JOIN cl USING (version_id, class_id) WHERE version_id = '1996' AND class_id IN (7, 70, 77)),
k AS (SELECT DISTINCT y || ':' || yarn_name AS key FROM m6 UNION SELECT yarn_name FROM c6 WHERE class_id IN (7, 70, 77) UNION SELECT 'y/none')
SELECT key, CASE WHEN key LIKE '%:%' THEN (SELECT CASE WHEN count(*) = 1 THEN max(z || ':' || m6.mojmap_name) END FROM m6 WHERE y || ':' || m6.yarn_name = key) ELSE (SELECT max(mojmap_name) FROM c6 WHERE yarn_name = key) END AS result FROM k""")
def engine_translate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of some classes and all their members from one namespace to another; ambiguous names give nothing."""
    e = engine(spark, sf_dir)
    own = e._classes("1996").where("class_id in (7, 70, 77)").select("class_id", F.col("yarn_name").alias("y"))
    keys = e._members("1996").join(own, "class_id").select(F.concat_ws(":", "y", "yarn_name").alias("key")).union(own.select("y")).union(spark.createDataFrame([("y/none",)], "key string")).distinct()
    return e.translate("1996", keys, "yarn", "mojmap")


@query(_E + """
, t AS (SELECT unnest(['t/T1:f1:()V', 't/T8:f1:()V', 't/T9:none']) AS target)
SELECT version_id, target, ref_owner, ref_member, cnt FROM rf JOIN t ON target = owner || ':' || member WHERE version_id IN ('1995', '1996', '1997')""")
def engine_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who refers to some targets in some versions."""
    return engine(spark, sf_dir).references(["1995", "1996", "1997"], ["t/T1:f1:()V", "t/T8:f1:()V", "t/T9:none"], "mojmap").select("version_id", "target", "ref_owner", "ref_member", "cnt")


@query(_E + """
, d AS (SELECT owner, parent, slots FROM de WHERE version_id = '1996'), k AS (SELECT 'm/C' || o AS owner, s FROM (SELECT unnest([1, 7, 11, 75, 123, 999999]) AS o), generate_series(1, 8) g(s)),
up AS (SELECT DISTINCT k.owner AS root, k.owner AS node, 0 AS depth FROM k WHERE k.owner IN (SELECT owner FROM d) UNION ALL SELECT root, d.parent, depth + 1 FROM up JOIN d ON d.owner = up.node WHERE d.parent IS NOT NULL),
h AS (SELECT k.owner, s, coalesce(list_contains(slots, s), false) AS has FROM k LEFT JOIN d USING (owner)),
f AS (SELECT h.owner, h.s, arg_min(u.node, u.depth) AS place FROM h JOIN up u ON u.root = h.owner AND u.depth > 0 JOIN d ON d.owner = u.node AND list_contains(d.slots, h.s) WHERE NOT has GROUP BY h.owner, h.s)
SELECT h.owner || ':n' || h.s || ':()V' AS key, has AS "exists", CASE WHEN place IS NOT NULL THEN 'inherited' END AS reason, place || ':n' || h.s || ':()V' AS nearest FROM h LEFT JOIN f ON f.owner = h.owner AND f.s = h.s""", recursive=True)
def engine_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether some members are declared, and where the nearest one is that is inherited."""
    keys = spark.createDataFrame([(f"m/C{o}:n{s}:()V",) for o in (1, 7, 11, 75, 123, 999999) for s in range(1, 9)], "key string")
    return engine(spark, sf_dir).exists("1996", "mojmap", keys)


@query(_E + """
, e AS (SELECT 0 AS kr, class_id AS id, mojmap_name AS n, simple_name AS s FROM cl WHERE version_id = '1997' UNION ALL SELECT CASE kind WHEN 'method' THEN 1 ELSE 2 END, member_id, cl.mojmap_name || '#' || me.mojmap_name, me.yarn_name FROM me JOIN cl USING (version_id, class_id) WHERE version_id = '1997'),
x AS (SELECT kr, id, n, regexp_extract_all(lower(n), '[\\p{L}\\p{N}]+') || regexp_extract_all(lower(s), '[\\p{L}\\p{N}]+') AS ts FROM e), c AS (SELECT count(*) AS n_, avg(len(ts)) AS avgdl FROM x),
h AS (SELECT kr, id, n, len(ts) AS dl, len([t FOR t IN ts IF t LIKE 'c1%']) AS tf FROM x), d AS (SELECT count(*) AS df FROM h WHERE tf > 0),
s AS (SELECT kr, id, n, greatest(ln((n_ - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) AS score FROM h, c, d WHERE tf > 0)
SELECT ['class', 'method', 'field'][kr + 1] AS kind, id, n AS mojmap_name, round(score / (1 + score), 6) AS score FROM s ORDER BY kr, round(score, 9) DESC, id LIMIT 40""")
def engine_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ranked page of names of a version, answered from the engine's stored index."""
    e = engine(spark, sf_dir)
    e.build_search_index(derived(spark, "engine-index", f"{sf_dir}/orders.parquet", f"{sf_dir}/lineitem.parquet"), ["1997"])
    return e.search("C1", "1997", ns="mojmap", limit=40).select("kind", "id", "mojmap_name", F.round("score", 6).alias("score"))


@query(_E + """
, s AS (SELECT kind, obf_name, obf_desc, yarn_name, mojmap_name, CASE WHEN yarn_name = mojmap_name THEN 'same' ELSE 'different' END AS status FROM me WHERE version_id = '1996' AND class_id IN (SELECT class_id FROM cl WHERE version_id = '1996' AND mojmap_name = 'm/C7'))
SELECT * FROM s""")
def engine_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of one class under two namings."""
    return engine(spark, sf_dir).compare("1996", "m/C7", "mojmap")


@query(_E + " SELECT obf_name, intermediary_name, yarn_name, mojmap_name, package_path, simple_name, 'both' AS presence FROM cl WHERE version_id = '1996'")
def engine_class_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All classes of a version."""
    return engine(spark, sf_dir).list_classes("1996")
