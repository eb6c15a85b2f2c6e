"""Queries of correspondence joins, lookups and translation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verspan.functions.text import export_key, key_parts, map_types, package_path, simple_name
from verspan.operators import correspondence as C
from verspan.plans.bindings import classes, members, orders, references, table
from verspan.plans.registry import query


@query("""
WITH y AS (SELECT c_custkey AS k, 'y' || c_name AS yarn FROM customer WHERE c_custkey % 2 = 0),
i AS (SELECT c_custkey AS k, 'i' || c_nationkey AS intermediary FROM customer WHERE c_custkey % 3 = 0),
m AS (SELECT c_custkey AS k, 'm' || c_mktsegment AS mojmap FROM customer WHERE c_custkey % 5 = 0)
SELECT k, yarn, intermediary, mojmap, CASE WHEN (yarn IS NOT NULL OR intermediary IS NOT NULL) AND mojmap IS NOT NULL THEN 'both' WHEN mojmap IS NOT NULL THEN 'mojmap_only' ELSE 'yarn_only' END AS presence
FROM y FULL JOIN i USING (k) FULL JOIN m USING (k)""", model=False)
def corr_full_outer3(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "k")
    y = c.where("k % 2 = 0").select("k", F.concat(F.lit("y"), "c_name").alias("x"))
    i = c.where("k % 3 = 0").select("k", F.concat(F.lit("i"), F.col("c_nationkey").cast("string")).alias("x"))
    m = c.where("k % 5 = 0").select("k", F.concat(F.lit("m"), "c_mktsegment").alias("x"))
    out = C.outer_join([("yarn", y), ("intermediary", i), ("mojmap", m)], "k")
    return out.withColumn("presence", C.presence(F.col("yarn"), F.col("intermediary"), F.col("mojmap")))


@query("""
, x AS (SELECT owner, slot, CASE WHEN bucket > 0 THEN bucket END AS bucket, min(name) AS a FROM members WHERE v = 1995 GROUP BY ALL),
y AS (SELECT owner, slot, CASE WHEN bucket > 0 THEN bucket END AS bucket, min(name) AS b FROM members WHERE v = 1996 GROUP BY ALL)
SELECT coalesce(x.owner, y.owner) AS owner, coalesce(x.slot, y.slot) AS slot, coalesce(x.bucket, y.bucket) AS bucket, a, b
FROM x FULL JOIN y ON x.owner = y.owner AND x.slot = y.slot AND x.bucket IS NOT DISTINCT FROM y.bucket""")
def corr_member_nullsafe(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = members(spark, sf_dir).withColumn("bucket", F.when(F.col("bucket") > 0, F.col("bucket")))
    one = lambda v, c: C.first_wins(m.where(F.col("v") == v), ["owner", "slot", "bucket"], ["name"]).select("owner", "slot", "bucket", F.col("name").alias(c))
    return C.null_safe_join(one(1995, "a"), one(1996, "b"), ["owner", "slot"], ["bucket"])


@query("""
WITH a AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 > 0 THEN c_name END AS name, CASE WHEN c_custkey % 4 > 0 THEN c_mktsegment END AS seg FROM customer WHERE c_custkey % 2 = 0),
b AS (SELECT c_custkey AS k, 'b' || c_name AS name, 'b' || c_mktsegment AS seg FROM customer WHERE c_custkey % 5 < 3),
m AS (SELECT k, coalesce(a.name, b.name) AS name, coalesce(a.seg, b.seg) AS seg FROM a FULL JOIN b USING (k))
SELECT * FROM m UNION ALL SELECT c_custkey, c_name, 'only' FROM customer WHERE c_custkey NOT IN (SELECT k FROM m)""", model=False)
def merge_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "k")
    a = c.where("k % 2 = 0").select("k", F.when(F.col("k") % 3 > 0, F.col("c_name")).alias("name"), F.when(F.col("k") % 4 > 0, F.col("c_mktsegment")).alias("seg"))
    b = c.where("k % 5 < 3").select("k", F.concat(F.lit("b"), "c_name").alias("name"), F.concat(F.lit("b"), "c_mktsegment").alias("seg"))
    return C.with_missing(C.merge_coalesce([a, b], ["k"], ["name", "seg"]), c.select("k", F.col("c_name").alias("name"), F.lit("only").alias("seg")), ["k"])


@query("""
, keys AS (SELECT DISTINCT owner, slot, (slot + owner) % 4 AS bucket FROM members WHERE v = 1996),
m AS (SELECT DISTINCT owner, slot, bucket FROM members WHERE v = 1996),
x AS (SELECT k.*, e.slot IS NOT NULL AS found,
  (SELECT min(m.bucket) FROM m WHERE m.owner = k.owner AND m.slot = k.slot) AS same, (SELECT min(m.slot) FROM m WHERE m.owner = k.owner AND m.bucket = k.bucket) AS other
  FROM keys k LEFT JOIN m e ON e.owner = k.owner AND e.slot = k.slot AND e.bucket = k.bucket)
SELECT owner, slot, bucket, found, CASE WHEN found THEN NULL WHEN same IS NOT NULL THEN 'descriptor' WHEN other IS NOT NULL THEN 'kind' END AS reason,
  CASE WHEN found THEN NULL WHEN same IS NOT NULL THEN owner || ':' || slot || ':' || same WHEN other IS NOT NULL THEN owner || ':' || other || ':' || bucket END AS nearest FROM x""")
def exists_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether keys are declared, else the nearest declaration: same name first, then any other."""
    m = members(spark, sf_dir).where("v = 1996").select("owner", "slot", "bucket").distinct()
    keys = m.select("owner", "slot", ((F.col("slot") + F.col("owner")) % 4).alias("bucket")).distinct()
    hit = keys.join(m.withColumn("found", F.lit(True)), ["owner", "slot", "bucket"], "left")
    same = m.groupBy("owner", "slot").agg(F.min("bucket").alias("same"))
    other = m.groupBy("owner", "bucket").agg(F.min("slot").alias("other"))
    x = hit.join(same, ["owner", "slot"], "left").join(other, ["owner", "bucket"], "left").withColumn("found", F.coalesce("found", F.lit(False)))
    near = F.when(F.col("same").isNotNull(), F.concat_ws(":", "owner", "slot", "same")).when(F.col("other").isNotNull(), F.concat_ws(":", "owner", "other", "bucket"))
    reason = F.when(F.col("same").isNotNull(), "descriptor").when(F.col("other").isNotNull(), "kind")
    return x.select("owner", "slot", "bucket", "found", F.when(~F.col("found"), reason).alias("reason"), F.when(~F.col("found"), near).alias("nearest"))


@query("""
WITH keys AS (SELECT c_custkey AS id, 'N' || (c_nationkey + c_custkey % 3) AS key FROM customer),
n AS (SELECT 'N' || n_nationkey AS key, n_name AS name, 1 AS p FROM nation UNION ALL SELECT 'N' || (20 + r_regionkey * 2), 'region ' || r_name, 2 FROM region)
SELECT id, key, (SELECT arg_min(name, p) FROM n WHERE n.key = keys.key) AS target FROM keys""", model=False)
def translate_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys translated by the first lookup that has them."""
    keys = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("N"), (F.col("c_nationkey") + F.col("c_custkey") % 3).cast("string")).alias("key"))
    one = table(spark, sf_dir, "nation").select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("key"), F.col("n_name").alias("target"))
    two = table(spark, sf_dir, "region").select(F.concat(F.lit("N"), (20 + F.col("r_regionkey") * 2).cast("string")).alias("key"), F.concat(F.lit("region "), "r_name").alias("target"))
    return keys.join(C.first_found([one, two], ["key"]), "key", "left").select("id", "key", "target")


@query("""
SELECT c_custkey AS id, '(L' || coalesce((SELECT n_name FROM nation WHERE n_nationkey = c_nationkey), '') || ';I[L99;)V(L' || c_custkey AS descriptor FROM customer""", model=False)
def descriptor_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "nation").agg(F.map_from_entries(F.collect_list(F.struct(F.col("n_nationkey").cast("string"), "n_name"))).alias("names"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.format_string("(L%s;I[L99;)V(L%s", F.col("c_nationkey").cast("string"), F.col("c_custkey").cast("string")).alias("d"))
    return c.join(F.broadcast(names)).select("id", map_types(F.col("d"), F.col("names")).alias("descriptor"))


@query("""
WITH x AS (SELECT p_partkey AS k, CASE WHEN p_size % 4 > 0 THEN p_brand END AS yarn, CASE WHEN p_size % 3 > 0 THEN CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE p_type END END AS mojmap FROM part)
SELECT k, CASE WHEN yarn IS NULL AND mojmap IS NULL THEN 'unmapped' WHEN yarn IS NULL THEN 'unmappedYarn' WHEN mojmap IS NULL THEN 'unmappedMojmap' WHEN yarn = mojmap THEN 'same' ELSE 'different' END AS status FROM x""", model=False)
def compare_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.when(F.col("p_size") % 4 > 0, F.col("p_brand")).alias("yarn"), F.when(F.col("p_size") % 3 > 0, F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).otherwise(F.col("p_type"))).alias("mojmap"))
    y, m = F.col("yarn"), F.col("mojmap")
    return x.select("k", F.when(y.isNull() & m.isNull(), "unmapped").when(y.isNull(), "unmappedYarn").when(m.isNull(), "unmappedMojmap").when(y == m, "same").otherwise("different").alias("status"))


@query(", q AS (SELECT o_orderkey AS k, c_name AS owner, CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority END AS member FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_custkey % 2 = 0) SELECT k, CASE WHEN owner IS NOT NULL AND member IS NOT NULL THEN owner || '#' || member END AS full_name, coalesce(member, owner, 'k' || k) AS stable FROM q")
def qualified_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("owner"))
    q = table(spark, sf_dir, "orders").join(c, "o_custkey", "left").select(F.col("o_orderkey").alias("k"), "owner", F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderpriority")).alias("member"))
    return q.select("k", C.qualified(F.col("owner"), F.col("member")).alias("full_name"), F.coalesce("member", "owner", F.concat(F.lit("k"), F.col("k").cast("string"))).alias("stable"))


@query("""
SELECT d.doc_id, lang, quality, toxic FROM documents d LEFT JOIN (SELECT doc_id, min(quality) AS quality, min_by(toxic, quality) AS toxic FROM labels GROUP BY doc_id) l USING (doc_id)""", model=False)
def entity_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = C.first_wins(table(spark, sf_dir, "labels"), ["doc_id"], ["quality", "toxic"])
    return table(spark, sf_dir, "documents").select("doc_id", "lang").join(labels, "doc_id", "left").select("doc_id", "lang", "quality", "toxic")


@query("""
WITH n AS (SELECT p_partkey AS k, p_brand || '/' || p_name AS name FROM part), s AS (SELECT split_part(name, '/', 2) AS simple, CASE WHEN count(*) = 1 THEN max(k) END AS only, count(*) AS n FROM n GROUP BY 1),
q AS (SELECT DISTINCT name AS q FROM n UNION SELECT DISTINCT split_part(name, '/', 2) FROM n UNION SELECT DISTINCT split_part(name, '/', 1) FROM n)
SELECT q, CASE WHEN e.k IS NOT NULL THEN e.k ELSE s.only END AS k, CASE WHEN e.k IS NOT NULL THEN 'exact' WHEN s.only IS NOT NULL THEN 'simple' ELSE 'none' END AS how
FROM q LEFT JOIN (SELECT name, min(k) AS k FROM n GROUP BY name) e ON e.name = q LEFT JOIN s ON s.simple = q""", model=False)
def name_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A name resolved exactly, else by a simple name that only one row bears."""
    n = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.concat_ws("/", "p_brand", "p_name").alias("name"))
    q = n.select(F.col("name").alias("q")).union(n.select(simple_name(F.col("name")))).union(n.select(F.substring_index("name", "/", 1))).distinct()
    exact = n.groupBy(F.col("name").alias("q")).agg(F.min("k").alias("e"))
    only = C.unique_or_null(n.withColumn("q", simple_name(F.col("name"))), ["q"], "k", "only")
    return q.join(exact, "q", "left").join(only, "q", "left").select("q", F.coalesce("e", "only").alias("k"), F.when(F.col("e").isNotNull(), "exact").when(F.col("only").isNotNull(), "simple").otherwise("none").alias("how"))


@query("""
, a AS (SELECT k, max(v) AS build FROM classes WHERE v < 1999 AND k % 3 > 0 GROUP BY k), b AS (SELECT k, max(v) AS build FROM classes WHERE k % 4 > 0 GROUP BY k)
SELECT k, a.build AS local, b.build AS upstream, CASE WHEN a.k IS NULL THEN 'missing' WHEN b.k IS NULL THEN 'gone' WHEN a.build < b.build THEN 'stale' ELSE 'same' END AS state FROM a FULL JOIN b USING (k)""")
def store_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two listings with builds: what is missing, stale or gone."""
    c = classes(spark, sf_dir)
    a = c.where("v < 1999 and k % 3 > 0").groupBy("k").agg(F.max("v").alias("local"))
    b = c.where("k % 4 > 0").groupBy("k").agg(F.max("v").alias("upstream"))
    state = F.when(F.col("local").isNull(), "missing").when(F.col("upstream").isNull(), "gone").when(F.col("local") < F.col("upstream"), "stale").otherwise("same")
    return a.join(b, "k", "full").select("k", "local", "upstream", state.alias("state"))


@query("""
SELECT n_nationkey::BIGINT AS nation, count(*) AS n, string_agg(c_custkey::VARCHAR, ',' ORDER BY c_custkey) AS children FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey < 3 GROUP BY 1""", model=False)
def children_per_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("c_nationkey"))
    c = table(spark, sf_dir, "customer").join(known, "c_nationkey", "left_semi")
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("c_custkey")), lambda x: x.cast("string")), ",")
    return c.groupBy(F.col("c_nationkey").cast("long").alias("nation")).agg(F.count("*").alias("n"), ids.alias("children"))


@query("""
WITH j AS (SELECT user_id, arg_max(props, row(ts, event_id)) AS props FROM events GROUP BY user_id)
SELECT user_id, unnest(json_keys(props)) AS key, json_extract_string(props, '$.k') AS value FROM j""", model=False)
def json_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest JSON of each key, exploded."""
    j = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("props", F.struct("ts", "event_id")).alias("props"))
    return j.select("user_id", F.explode(F.from_json("props", "map<string,string>")).alias("key", "value"))


@query("""
WITH k AS (SELECT p_partkey AS k, p_brand || '/' || replace(p_name, ' ', '_') AS owner, 'm' || p_size AS name, '(I)V' AS d FROM part)
SELECT k, 'accessible method ' || owner || ' ' || name || ' ' || d AS aw, 'public ' || replace(owner, '/', '.') || ' ' || name || d AS at, 'L' || owner || ';' || name || d AS mixin, owner || ':' || name || ':' || d AS key, split_part(owner, '/', 1) AS package FROM k""", model=False)
def export_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat(F.col("p_brand"), F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit(":m"), F.col("p_size").cast("string"), F.lit(":(I)V"))
    owner, name, d = key_parts(F.col("key"))
    out = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), key.alias("key"))
    return out.select("k", *[export_key(owner, name, d, f).alias(f) for f in ("aw", "at", "mixin", "key")], package_path(owner).alias("package"))


@query("""
, e AS (SELECT owner, ref_owner, cnt, 'P' || owner || ':S' || ref_owner AS key FROM refs)
SELECT e.key, coalesce(s.s_name, 'S' || ref_owner) AS name, cnt FROM e LEFT JOIN supplier s ON s.s_suppkey = ref_owner AND s_suppkey % 2 = 0""")
def remap_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names looked up by key parts, falling back to themselves."""
    s = table(spark, sf_dir, "supplier").where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("ref_owner"), "s_name")
    e = references(spark, sf_dir).join(s, "ref_owner", "left")
    mine = F.concat(F.lit("S"), F.col("ref_owner").cast("string"))
    return e.select(F.concat(F.lit("P"), F.col("owner").cast("string"), F.lit(":"), mine).alias("key"), F.coalesce("s_name", mine).alias("name"), "cnt")


@query("""
SELECT v, 'r' || v % 2 AS branch_of, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS branches, count(*) AS n FROM (SELECT * FROM o) GROUP BY v""")
def version_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags collected for each version."""
    return orders(spark, sf_dir).groupBy("v").agg(F.concat(F.lit("r"), (F.first("v") % 2).cast("string")).alias("branch_of"), F.array_join(F.sort_array(F.collect_set("o_orderstatus")), ",").alias("branches"), F.count("*").alias("n"))
