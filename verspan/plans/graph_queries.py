"""Queries over hierarchies and references."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verspan import schema
from verspan.engine import Engine
from verspan.operators import graph as G
from verspan.operators import references as R
from verspan.plans.bindings import hierarchy, lines_of, part_lines, references, table, tasks_for, versions
from verspan.plans.registry import query
from verspan.shared import derived, stored
from verspan.store.side_index import SideIndex


@query("""
, c AS (SELECT 'R1' AS root, 'R1' AS node, 0::BIGINT AS depth UNION ALL SELECT c.root, t.child, c.depth + 1 FROM c JOIN tree t ON t.parent = c.node)
SELECT root, node, min(depth) AS depth FROM c GROUP BY root, node""", recursive=True)
def hierarchy_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.closure(hierarchy(spark, sf_dir), spark.createDataFrame([("R1",)], "root string"), "parent", "child")


@query("""
, c AS (SELECT child AS root, child AS node, 0::BIGINT AS depth FROM tree UNION ALL SELECT c.root, t.parent, c.depth + 1 FROM c JOIN tree t ON t.child = c.node)
SELECT root, node, min(depth) AS depth FROM c GROUP BY root, node""", recursive=True)
def ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = hierarchy(spark, sf_dir)
    return G.bounded_closure(t, t.select(F.col("child").alias("root")), "child", "parent", 2)


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(callee, caller): part <- supplier <- nation <- region."""
    r = references(spark, sf_dir).select(F.concat(F.lit("P"), "owner").alias("callee"), F.concat(F.lit("S"), "ref_owner").alias("caller"))
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("S"), "s_suppkey"), F.concat(F.lit("N"), "s_nationkey"))
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("N"), "n_nationkey"), F.concat(F.lit("R"), "n_regionkey"))
    return r.union(s).union(n)


@query("""
, calls AS (SELECT DISTINCT 'P' || owner AS callee, 'S' || ref_owner AS caller FROM refs UNION SELECT 'S' || s_suppkey, 'N' || s_nationkey FROM supplier UNION SELECT 'N' || n_nationkey, 'R' || n_regionkey FROM nation),
w AS (SELECT t AS target, t AS at, [t] AS seen, ''::VARCHAR AS chain, 0 AS depth, false AS done FROM (VALUES ('P1'), ('P2')) x(t)
  UNION ALL SELECT w.target, c.caller, list_append(w.seen, c.caller), CASE WHEN w.chain = '' THEN c.caller ELSE c.caller || ' > ' || w.chain END, w.depth + 1, list_contains(w.seen, c.caller) FROM w JOIN calls c ON c.callee = w.at WHERE w.depth < 3 AND NOT w.done)
SELECT target, chain, row_number() OVER (PARTITION BY target ORDER BY chain) AS pos FROM (SELECT * FROM w WHERE depth = 3 OR done OR (depth > 0 AND NOT EXISTS (SELECT 1 FROM calls c WHERE c.callee = w.at))) QUALIFY pos <= 200""", recursive=True)
def call_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.call_chains(_calls(spark, sf_dir), spark.createDataFrame([("P1",), ("P2",)], "target string"), "callee", "caller", 3)


@query(" SELECT owner, ref_owner, cnt FROM refs")
def references_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.multiplicity(table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("owner"), F.col("l_suppkey").alias("ref_owner")), ["owner", "ref_owner"])


_SITES = """
, s AS (SELECT v, owner, l_linenumber::BIGINT AS method, string_agg(DISTINCT l_partkey::VARCHAR, ',' ORDER BY l_partkey::VARCHAR) AS targets FROM lines WHERE v IN (1995, 1996) GROUP BY v, owner, l_linenumber),
r0 AS (SELECT * FROM s a WHERE v = 1995 AND NOT EXISTS (SELECT 1 FROM s b WHERE b.v = 1996 AND b.owner = a.owner AND b.method = a.method)),
a0 AS (SELECT * FROM s a WHERE v = 1996 AND NOT EXISTS (SELECT 1 FROM s b WHERE b.v = 1995 AND b.owner = a.owner AND b.method = a.method)),
p1 AS (SELECT r.owner AS old_owner, r.method AS old_method, a.owner AS new_owner, a.method AS new_method, 1::BIGINT AS round FROM (SELECT * FROM r0 QUALIFY count(*) OVER (PARTITION BY targets, method) = 1) r JOIN (SELECT * FROM a0 QUALIFY count(*) OVER (PARTITION BY targets, method) = 1) a USING (targets, method)),
r1 AS (SELECT * FROM r0 WHERE (owner, method) NOT IN (SELECT (old_owner, old_method) FROM p1)), a1 AS (SELECT * FROM a0 WHERE (owner, method) NOT IN (SELECT (new_owner, new_method) FROM p1)),
p2 AS (SELECT r.owner, r.method, a.owner, a.method, 2::BIGINT FROM (SELECT * FROM r1 QUALIFY count(*) OVER (PARTITION BY targets, owner) = 1) r JOIN (SELECT * FROM a1 QUALIFY count(*) OVER (PARTITION BY targets, owner) = 1) a USING (targets, owner)),
q2(old_owner, old_method, new_owner, new_method, round) AS (SELECT * FROM p2),
r2 AS (SELECT * FROM r1 WHERE (owner, method) NOT IN (SELECT (old_owner, old_method) FROM q2)), a2 AS (SELECT * FROM a1 WHERE (owner, method) NOT IN (SELECT (new_owner, new_method) FROM q2)),
p3 AS (SELECT r.owner, r.method, a.owner, a.method, 3::BIGINT FROM (SELECT * FROM r2 QUALIFY count(*) OVER (PARTITION BY targets) = 1) r JOIN (SELECT * FROM a2 QUALIFY count(*) OVER (PARTITION BY targets) = 1) a USING (targets))
SELECT * FROM p1 UNION ALL SELECT * FROM q2 UNION ALL SELECT * FROM p3"""


@query(_SITES)
def references_diff_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = lines_of(spark, sf_dir, (1995, 1996)).select("v", "owner", F.col("l_linenumber").cast("long").alias("method"), F.col("l_partkey").cast("string").alias("t"))
    changed = R.one_sided(li.withColumn("side", F.when(F.col("v") == 1995, "old").otherwise("new")), ["owner", "method"], "t")
    pairs = R.pair_moves(stored(changed, "sites"), ["owner", "method"], [["targets", "method"], ["targets", "owner"], ["targets"]])
    return pairs.select(F.col("old.owner").alias("old_owner"), F.col("old.method").alias("old_method"), F.col("new.owner").alias("new_owner"), F.col("new.method").alias("new_method"), "round")


@query("""
, t AS (SELECT * FROM (VALUES (1), (2), (999999)) x(part), (VALUES (1995), (1996)) y(v)), e AS (SELECT v, l_partkey AS part, l_suppkey AS sup, count(*) AS cnt FROM lines GROUP BY ALL)
SELECT t.v::BIGINT AS v, t.part::BIGINT AS part, count(sup) > 0 AS resolved, coalesce(string_agg(sup || 'x' || cnt, ',' ORDER BY sup || 'x' || cnt), '') AS refs FROM t LEFT JOIN e USING (v, part) GROUP BY t.v, t.part""")
def references_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stated targets in stated versions, looked up at once."""
    t = spark.createDataFrame([(v, p) for v in (1995, 1996) for p in (1, 2, 999999)], "v long, part long")
    e = R.multiplicity(lines_of(spark, sf_dir).select("v", F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("sup")), ["v", "part", "sup"])
    e = e.join(F.broadcast(t), ["v", "part"], "left_semi").groupBy("v", "part").agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws("x", "sup", "cnt"))), ",").alias("refs"))
    return t.join(e, ["v", "part"], "left").select("v", "part", F.col("refs").isNotNull().alias("resolved"), F.coalesce("refs", F.lit("")).alias("refs"))


@query("""
, up AS (SELECT child AS root, child AS node, 0::BIGINT AS depth FROM tree WHERE child LIKE 'C%' UNION ALL SELECT u.root, t.parent, u.depth + 1 FROM up u JOIN tree t ON t.child = u.node),
d AS (SELECT 'C' || c_custkey AS node, c_mktsegment AS value FROM customer WHERE c_custkey % 10 = 0 UNION ALL SELECT 'N' || n_nationkey, n_name FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT 'R' || r_regionkey, r_name FROM region WHERE r_regionkey <> 3)
SELECT root, arg_min(node, depth) AS declared_in, min(depth) AS depth, arg_min(value, depth) AS value FROM up JOIN d USING (node) GROUP BY root""", recursive=True)
def inherited_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = hierarchy(spark, sf_dir)
    roots = t.where("child like 'C%'").select(F.col("child").alias("root"))
    d = table(spark, sf_dir, "customer").where("c_custkey % 10 = 0").select(F.concat(F.lit("C"), "c_custkey").alias("owner"), F.col("c_mktsegment").alias("value"))
    d = d.union(table(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").select(F.concat(F.lit("N"), "n_nationkey"), "n_name")).union(table(spark, sf_dir, "region").where("r_regionkey <> 3").select(F.concat(F.lit("R"), "r_regionkey"), "r_name"))
    return G.nearest_declaring(roots, G.bounded_closure(t, roots, "child", "parent", 2), d, "owner", "value")


@query("""
, k AS (SELECT v.v, p.part, p.sup FROM versions v, (SELECT DISTINCT l_partkey AS part, l_suppkey AS sup FROM lineitem) p),
e AS (SELECT v, l_partkey AS part, l_suppkey AS sup, count(*) AS hits FROM lines GROUP BY ALL), n AS (SELECT v, part, count(*) AS others, min(sup) AS moved FROM e GROUP BY v, part)
SELECT k.v, k.part, k.sup, CASE WHEN e.hits > 0 THEN 'ok' WHEN n.others = 1 THEN 'call_moved' WHEN n.others > 1 THEN 'renamed' ELSE 'missing' END AS verdict, e.hits AS at_count, CASE WHEN e.hits IS NULL AND n.others = 1 THEN n.moved END AS moved_to
FROM k LEFT JOIN e ON e.v = k.v AND e.part = k.part AND e.sup = k.sup LEFT JOIN n ON n.v = k.v AND n.part = k.part""")
def validate_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict ladder for stated targets: hits, a single other holder, several, none.

    A line is shuffled to its order and then to its part; a part's pairs, their counts of each
    version and its holders are found where its lines lie, and versions are added to what is found.
    """
    tasks = tasks_for(spark, sf_dir)
    lines = part_lines(spark, sf_dir, tasks, outer=True).repartition(tasks, "part")
    e = lines.groupBy("part", "sup", "v").agg(F.count("*").alias("n"))
    by_version, by_part, named = Window.partitionBy("part", "v"), Window.partitionBy("part"), F.col("v").isNotNull()
    e = e.withColumn("others", F.count("*").over(by_version)).withColumn("moved", F.min("sup").over(by_version))
    e = e.withColumn("held", F.collect_set(F.when(named, F.struct("v", F.struct("others", "moved").alias("h")))).over(by_part))  # one for each version
    counts = F.map_from_entries(F.collect_list(F.when(named, F.struct("v", "n"))))
    pairs = e.groupBy("part", "sup").agg(counts.alias("hits"), F.map_from_entries(F.any_value("held")).alias("held"))
    all_v = versions(spark, sf_dir).agg(F.collect_list(F.struct("v")).alias("vs"))  # structs keep a null version
    k = pairs.join(F.broadcast(all_v)).select("part", "sup", "hits", "held", F.explode("vs.v").alias("v"))
    at = lambda m, *keys: F.when(reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in ("v", *keys)]), F.try_element_at(m, F.coalesce("v", F.lit(0))))
    k = k.select("v", "part", "sup", at(F.col("hits"), "part", "sup").alias("at_count"), at(F.col("held"), "part").alias("h")).select("v", "part", "sup", "at_count", "h.others", "h.moved")
    verdict = F.when(F.col("at_count") > 0, "ok").when(F.col("others") == 1, "call_moved").when(F.col("others") > 1, "renamed").otherwise("missing")
    return k.select("v", "part", "sup", verdict.alias("verdict"), "at_count", F.when(F.col("at_count").isNull() & (F.col("others") == 1), F.col("moved")).alias("moved_to"))


def _side_refs(spark: SparkSession, sf_dir: str) -> SideIndex:
    """References of parts by year, a pair for each year; only years without an index are built."""
    tasks = tasks_for(spark, sf_dir)
    counted = R.multiplicity(part_lines(spark, sf_dir, tasks).repartition(tasks, "part", "sup", "v"), ["v", "part", "sup"])  # by numbers; they are named afterwards
    rows = counted.select(F.col("v").cast("string").alias("version_id"), F.lit("part").alias("ns"), F.col("part").cast("string").alias("owner"), F.col("sup").alias("ref_owner"), "cnt")
    index = SideIndex(spark, derived(spark, "side-refs", f"{sf_dir}/lineitem.parquet", f"{sf_dir}/orders.parquet"), "version_id string, ns string, owner string, ref_owner bigint, cnt bigint", "owner")
    index.build(rows, [(str(r["v"]), "part") for r in versions(spark, sf_dir).select("v").collect()])  # a row for each year
    return index


@query(" SELECT v::VARCHAR AS version_id, l_partkey::VARCHAR AS owner, l_suppkey AS ref_owner, count(*) AS cnt FROM lines GROUP BY ALL")
def side_index_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of the side index of references, every year's."""
    return _side_refs(spark, sf_dir).store.read().select("version_id", "owner", "ref_owner", "cnt")


@query(" SELECT v::VARCHAR AS version_id, l_partkey::VARCHAR AS owner, l_suppkey AS ref_owner, count(*) AS cnt FROM lines WHERE l_partkey IN (7, 11, 999999999) AND v IN (1995, 1997) GROUP BY ALL")
def side_index_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stated owners in stated versions, from their buckets; a year that isn't there is named as not built."""
    found, rest = _side_refs(spark, sf_dir).rows(["1995", "1997", "1000"], "part", ["7", "11", "999999999"])
    assert rest == ["1000"]
    return found.select("version_id", "owner", "ref_owner", "cnt")


@query(" SELECT v::VARCHAR AS version_id, count(*) AS n FROM (SELECT DISTINCT v, l_partkey, l_suppkey FROM lines) GROUP BY v")
def counts_at_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each year as they were counted while its part was written; nothing is scanned for it."""
    built = _side_refs(spark, sf_dir).store.built()
    return spark.createDataFrame([(p.partition("|")[0], b["rows"]) for p, b in built.items()], "version_id string, n long")


@query("""
, n AS (SELECT DISTINCT child AS node, parent AS up FROM tree UNION SELECT DISTINCT parent, NULL FROM tree WHERE parent NOT IN (SELECT child FROM tree)),
p AS (SELECT node, [node] AS path FROM n WHERE up IS NULL UNION ALL SELECT n.node, list_append(p.path, n.node) FROM p JOIN n ON n.up = p.node),
f AS (SELECT node, path, row_number() OVER (ORDER BY path) AS first FROM p), c AS (SELECT unnest(path) AS node, count(*) AS size FROM p GROUP BY 1)
SELECT node, len(path) - 1 AS depth, first, first + size - 1 AS last FROM f JOIN c USING (node)""", recursive=True)
def hierarchy_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node's interval: what lies below a node is what its interval holds, without a walk."""
    t = hierarchy(spark, sf_dir)
    top = t.select("parent").distinct().join(t.select(F.col("child").alias("parent")), "parent", "left_anti").select(F.col("parent").alias("node"), F.lit(None).cast("string").alias("up"))
    nodes = t.select(F.col("child").alias("node"), F.col("parent").alias("up")).union(top).withColumn("v", F.lit(0))
    return G.tree_labels(nodes, ["v"], "node", "up").drop("v")


@query("""
, u AS (SELECT DISTINCT parent AS node FROM tree UNION SELECT child FROM tree), up AS (SELECT node AS root, node FROM u UNION SELECT up.root, t.parent FROM up JOIN tree t ON t.child = up.node),
d AS (SELECT root AS node, node AS root FROM up)
SELECT root, count(DISTINCT node)::BIGINT AS nodes, (count(DISTINCT node) - 1)::BIGINT AS edges FROM (SELECT root, node FROM up UNION SELECT root, node FROM d) GROUP BY root""", recursive=True)
def hierarchy_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph above and below every class at once, by the engine over declarations: how many nodes and edges."""
    t = hierarchy(spark, sf_dir)
    owners = t.select(F.col("child").alias("owner"), F.array("parent").alias("supertypes")).union(t.select("parent").distinct().join(t.select(F.col("child").alias("parent")), "parent", "left_anti").select("parent", F.array().cast("array<string>")))
    decls = owners.select(F.lit("1").alias("version_id"), F.lit("all").alias("ns"), "owner", F.lit(1).alias("access"), "supertypes", F.array().cast("array<string>").alias("subtypes"), F.array().cast("array<struct<name: string, descriptor: string>>").alias("members"))
    none = spark.createDataFrame([], schema.VERSIONS)
    nodes, edges = Engine(spark, none, spark.createDataFrame([], schema.CLASSES), spark.createDataFrame([], schema.MEMBERS), decls).hierarchies("1", "all")
    return nodes.groupBy("root").agg(F.count("*").alias("nodes")).join(edges.groupBy("root").agg(F.count("*").alias("edges")), "root")
