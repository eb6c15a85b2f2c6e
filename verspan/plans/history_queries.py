"""Queries over ordered versions: spans, runs, ranges, catalogs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verspan.functions.text import body_hash, release_type, semver
from verspan.operators import correspondence as C
from verspan.operators import spans as S
from verspan.plans.bindings import classes, members, orders, table, versions
from verspan.plans.registry import query
from verspan.shared import shared_dir
from verspan.store.runs import GrowingRuns, changes_of

_ISLANDS = """
grid AS (SELECT e.k, v.v FROM (SELECT DISTINCT k FROM classes) e, versions v),
s AS (SELECT g.k, g.v, c.name, c.k IS NOT NULL AS present FROM grid g LEFT JOIN classes c ON c.k = g.k AND c.v = g.v),
m AS (SELECT *, CASE WHEN lag(1) OVER w IS NULL OR (present, name) IS DISTINCT FROM (lag(present) OVER w, lag(name) OVER w) THEN 1 ELSE 0 END AS new FROM s WINDOW w AS (PARTITION BY k ORDER BY v)),
i AS (SELECT *, sum(new) OVER (PARTITION BY k ORDER BY v) AS island FROM m)
"""


@query("," + _ISLANDS + "SELECT k, present, name, min(v) AS from_v, max(v) AS to_v, count(*) AS versions FROM i GROUP BY k, island, present, name")
def history_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = classes(spark, sf_dir).withColumn("present", F.lit(True))
    g = S.dense(c.select("k").distinct(), versions(spark, sf_dir).select("v"), c, ["k", "v"])
    return S.collapse(g.withColumn("present", F.coalesce("present", F.lit(False))), ["k"], "v", ["present", "name"])


_RUNS = """
, m AS (SELECT *, CASE WHEN lag(v) OVER w IS NULL OR lag(v) OVER w <> v - 1 OR name IS DISTINCT FROM lag(name) OVER w THEN 1 ELSE 0 END AS new FROM classes WINDOW w AS (PARTITION BY k ORDER BY v)),
i AS (SELECT *, sum(new) OVER (PARTITION BY k ORDER BY v) AS island FROM m),
runs AS (SELECT k, name, min(v) AS from_ord, max(v) AS to_ord FROM i GROUP BY k, island, name)
"""


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change log: a name where it is set, null where the class goes."""
    c = classes(spark, sf_dir)
    last = versions(spark, sf_dir).agg(F.max("v").alias("last"))
    w = Window.partitionBy("k").orderBy("v")
    gone = c.withColumn("next", F.lead("v").over(w)).withColumn("o", F.col("v") + 1).join(F.broadcast(last)).where((F.coalesce("next", F.lit(-1)) != F.col("o")) & (F.col("o") <= F.col("last")))
    log = c.select("k", "v", "name").unionByName(gone.select("k", F.col("o").alias("v"), F.lit(None).cast("string").alias("name")))
    return S.runs(log.join(F.broadcast(last)), ["k"], "v", "name", F.lit(None).cast("long")).join(F.broadcast(last)).withColumn("to_ord", F.coalesce("to_ord", "last")).drop("last")


@query(_RUNS + "SELECT * FROM runs")
def resource_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _runs(spark, sf_dir)


@query(_RUNS + "SELECT k, name FROM runs WHERE 1997 BETWEEN from_ord AND to_ord")
def resource_point_in_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.at_point(_runs(spark, sf_dir), 1997).select("k", "name")


@query(_RUNS + """, a AS (SELECT * FROM runs WHERE 1996 BETWEEN from_ord AND to_ord), b AS (SELECT * FROM runs WHERE 1997 BETWEEN from_ord AND to_ord)
SELECT k, a.name AS old_value, b.name AS new_value, CASE WHEN a.name IS NULL THEN 'added' WHEN b.name IS NULL THEN 'removed' ELSE 'modified' END AS change
FROM a FULL JOIN b USING (k) WHERE a.name IS DISTINCT FROM b.name""")
def resource_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.interval_diff(_runs(spark, sf_dir), ["k"], "name", 1996, 1997)


@query("""
WITH p AS (SELECT regexp_replace(split_part(split_part(url, '://', 2), '?', 1), '#.*$', '') AS path FROM pages),
h AS (SELECT split_part(path, '/', 1) AS host, path FROM p),
r AS (SELECT split_part(substr(path, length(host) + 2), '/', 1) AS name, substr(path, length(host) + 2) LIKE '%/%' AS is_dir FROM h WHERE path LIKE '%.example.com/%')
SELECT DISTINCT name, is_dir FROM r WHERE name <> ''""", model=False)
def resource_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_replace(F.regexp_replace(F.substring_index("url", "://", -1), r"\?.*$", ""), "#.*$", "")
    p = table(spark, sf_dir, "pages").select(path.alias("p")).where("p like '%.example.com/%'")
    return S.directory(p.select(F.concat(F.lit("all/"), F.expr("substr(p, length(substring_index(p, '/', 1)) + 2)")).alias("path")), "all")


@query("""
WITH kv AS (SELECT user_id, ts, event_id, key, json_extract_string(props, '$."' || key || '"') AS value FROM (SELECT *, unnest(json_keys(props)) AS key FROM events)),
m AS (SELECT *, CASE WHEN lag(1) OVER w IS NULL OR value IS DISTINCT FROM lag(value) OVER w THEN 1 ELSE 0 END AS new FROM kv WINDOW w AS (PARTITION BY user_id, key ORDER BY ts, event_id)),
i AS (SELECT *, sum(new) OVER (PARTITION BY user_id, key ORDER BY ts, event_id) AS island FROM m)
SELECT user_id, key, value, min(event_id) AS first_event, max(event_id) AS last_event, count(*) AS n FROM i GROUP BY user_id, key, island, value""", model=False)
def translation_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    kv = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.explode(F.from_json("props", "map<string,string>")).alias("key", "value"))
    return S.islands(kv, ["user_id", "key"], ["ts", "event_id"], ["value"]).groupBy("user_id", "key", "island", "value").agg(F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event"), F.count("*").alias("n")).drop("island")


@query("""
, anchor AS (SELECT name AS q, arg_max(k, row(v, k)) AS anchor FROM classes GROUP BY name),
uniq AS (SELECT v, name, CASE WHEN count(*) = 1 THEN max(k) END AS only FROM classes GROUP BY v, name),
met AS (SELECT c.v, c.k, a.q FROM anchor a JOIN classes c ON c.name = a.q UNION SELECT c.v, c.k, a.q FROM anchor a JOIN classes c ON c.k = a.anchor)
SELECT c.v, c.q, count(*) AS rows, max(u.only) AS only FROM met c LEFT JOIN uniq u ON u.v = c.v AND u.name = c.q GROUP BY c.v, c.q""")
def history_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a name or of the key that bore it last; the key if the name is unique in its version."""
    c = classes(spark, sf_dir)
    anchor = c.groupBy(F.col("name").alias("q")).agg(F.max_by("k", F.struct("v", "k")).alias("anchor"))
    by_name = c.join(anchor, F.col("name") == F.col("q")).select("v", "k", "q")
    by_key = c.join(anchor, F.col("k") == F.col("anchor")).select("v", "k", "q")
    only = C.unique_or_null(c, ["v", "name"], "k", "only").withColumnRenamed("name", "q")
    return by_name.union(by_key).distinct().join(only, ["v", "q"], "left").groupBy("v", "q").agg(F.count("*").alias("rows"), F.max("only").alias("only"))


@query("""
SELECT event_id, user_id, last_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS last_click FROM events""", model=False)
def locf_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.last_seen(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type") == "click", "event_id", "last_click").select("event_id", "user_id", "last_click")


@query("""
, t AS (SELECT p_partkey AS k, (1 + p_size % 3) || '.' || (p_size % 12) || CASE WHEN p_partkey % 5 = 0 THEN '-pre.' || (p_partkey % 11) WHEN p_partkey % 5 = 1 THEN '-rc' WHEN p_partkey % 5 = 2 THEN '.' || (p_partkey % 4) ELSE '' END AS version FROM part)
SELECT k, version, dense_rank() OVER (ORDER BY
  split_part(split_part(version, '-', 1), '.', 1)::INT, split_part(split_part(version, '-', 1), '.', 2)::INT, coalesce(try_cast(split_part(split_part(version, '-', 1), '.', 3) AS INT), 0),
  CASE WHEN version LIKE '%-%' THEN 0 ELSE 1 END, split_part(split_part(version, '-', 2), '.', 1), coalesce(try_cast(split_part(version, '-pre.', 2) AS INT), 0)) AS rank FROM t""")
def semver_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    tail = F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("-pre."), (F.col("p_partkey") % 11).cast("string"))).when(F.col("p_partkey") % 5 == 1, "-rc").when(F.col("p_partkey") % 5 == 2, F.concat(F.lit("."), (F.col("p_partkey") % 4).cast("string"))).otherwise("")
    t = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.concat((1 + F.col("p_size") % 3).cast("string"), F.lit("."), (F.col("p_size") % 12).cast("string"), tail).alias("version"))
    # ranked over the distinct versions, which are few, and joined back
    v = t.select("version").distinct().withColumn("s", semver(F.col("version")))
    v = v.select("version", F.dense_rank().over(Window.orderBy("s")).cast("long").alias("rank"))
    return t.join(F.broadcast(v), "version").select("k", "version", "rank")


@query(", x AS (SELECT v, is_release FROM versions ORDER BY is_release DESC, v DESC LIMIT 1) SELECT * FROM x")
def latest_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions(spark, sf_dir).select("v", "is_release").orderBy(F.desc("is_release"), F.desc("v")).limit(1)


@query(", n AS (SELECT v, count(*) AS classes FROM classes GROUP BY v) SELECT versions.v, rank, is_release, classes FROM versions JOIN n ON n.v = versions.v WHERE is_release AND versions.v::VARCHAR LIKE '199%'")
def version_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = classes(spark, sf_dir).groupBy("v").agg(F.count("*").alias("classes"))
    return versions(spark, sf_dir).where(F.col("is_release") & F.col("v").cast("string").startswith("199")).join(n, "v").select("v", "rank", "is_release", "classes")


@query(", b AS (SELECT min(rank) AS lo, max(rank) AS hi FROM versions WHERE v IN (1999, 1996)) SELECT v, rank FROM versions, b WHERE rank BETWEEN lo AND hi AND is_release")
def version_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slice between two bounds in either order; filters narrow the content, not the bounds."""
    v = versions(spark, sf_dir)
    b = v.where("v in (1999, 1996)").agg(F.min("rank").alias("lo"), F.max("rank").alias("hi"))
    return v.join(F.broadcast(b), F.col("rank").between(F.col("lo"), F.col("hi"))).where("is_release").select("v", "rank")


@query(", n AS (SELECT v, count(*) AS n FROM classes GROUP BY v) SELECT v, n AS classes, v % 2 = 0 AS stored FROM n")
def stored_or_scanned_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored counts where there are any, else counted."""
    c = classes(spark, sf_dir)
    stored = c.where("v % 2 = 0").groupBy("v").agg(F.count("*").alias("known"))
    scanned = c.groupBy("v").agg(F.count("*").alias("n"))
    return scanned.join(stored, "v", "left").select("v", F.coalesce("known", "n").alias("classes"), F.col("known").isNotNull().alias("stored"))


@query("""
, h AS (SELECT owner AS k, v, substr(sha256(string_agg(slot || ':' || bucket || chr(10) || regexp_replace('call lambda$' || name || '$' || v, 'lambda\\$([^$\\s()]+)\\$\\d+', 'lambda$\\1', 'g'), chr(10) ORDER BY slot || ':' || bucket)), 1, 16) AS hash FROM members GROUP BY owner, v),
m AS (SELECT *, CASE WHEN lag(1) OVER w IS NULL OR hash IS DISTINCT FROM lag(hash) OVER w THEN 1 ELSE 0 END AS new FROM h WINDOW w AS (PARTITION BY k ORDER BY v)),
i AS (SELECT *, sum(new) OVER (PARTITION BY k ORDER BY v) AS island FROM m)
SELECT k, hash, min(v) AS from_v, max(v) AS to_v, count(*) AS versions FROM i GROUP BY k, island, hash""")
def body_hash_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = members(spark, sf_dir)
    h = m.groupBy(F.col("owner").alias("k"), "v").agg(body_hash(F.collect_list(F.struct(F.concat_ws(":", "slot", "bucket").alias("descriptor"), F.concat(F.lit("call lambda$"), "name", F.lit("$"), F.col("v").cast("string")).alias("body")))).alias("hash"))
    return S.collapse(h, ["k"], "v", ["hash"])


@query("""
WITH t AS (SELECT DISTINCT CASE p_partkey % 7 WHEN 6 THEN (20 + p_size % 5) || 'w' || (10 + p_size % 9) || 'a' ELSE (p_size % 3 + 1) || '.' || (p_size % 9) || CASE p_partkey % 7 WHEN 0 THEN '-RC1' WHEN 1 THEN '-pre2' WHEN 2 THEN '-snapshot' WHEN 3 THEN '-beta' WHEN 4 THEN '' ELSE '~x' END END AS version FROM part)
SELECT version, CASE WHEN contains(lower(version), 'rc') THEN 'release-candidate' WHEN contains(lower(version), 'pre') THEN 'pre-release' WHEN regexp_full_match(version, '\\d+w\\d+[a-z]?') THEN 'snapshot'
  WHEN regexp_full_match(version, '\\d+\\.\\d+(\\.\\d+)?') THEN 'release' ELSE 'snapshot' END AS kind FROM t""", model=False)
def release_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    tails = F.element_at(F.array(*[F.lit(x) for x in ("-RC1", "-pre2", "-snapshot", "-beta", "", "~x", "")]), (F.col("p_partkey") % 7 + 1).cast("int"))
    weekly = F.concat((20 + F.col("p_size") % 5).cast("string"), F.lit("w"), (10 + F.col("p_size") % 9).cast("string"), F.lit("a"))
    numbered = F.concat((F.col("p_size") % 3 + 1).cast("string"), F.lit("."), (F.col("p_size") % 9).cast("string"), tails)
    t = table(spark, sf_dir, "part").select(F.when(F.col("p_partkey") % 7 == 6, weekly).otherwise(numbered).alias("version")).distinct()
    return t.select("version", release_type(F.col("version")).alias("kind"))


@query(", f AS (SELECT o_orderpriority AS name, min(row(o_orderdate, o_orderkey)) AS first FROM o GROUP BY 1) SELECT name, row_number() OVER (ORDER BY first) - 1 AS idx FROM f")
def blame_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct values numbered by first occurrence; they are few after the aggregation."""
    f = orders(spark, sf_dir).groupBy(F.col("o_orderpriority").alias("name")).agg(F.min(F.struct("o_orderdate", "o_orderkey")).alias("first"))
    return f.select("name", (F.row_number().over(Window.orderBy("first")) - 1).cast("long").alias("idx"))


@query("""
WITH c AS (SELECT event_type AS branch, user_id::VARCHAR AS path, event_id AS ord, CASE WHEN value >= 20 THEN floor(value / 25)::BIGINT::VARCHAR END AS value FROM events),
h AS (SELECT branch, max(ord) AS head FROM c GROUP BY branch),
m AS (SELECT *, CASE WHEN lag(1) OVER w IS NULL OR value IS DISTINCT FROM lag(value) OVER w THEN 1 ELSE 0 END AS new FROM c WINDOW w AS (PARTITION BY branch, path ORDER BY ord)),
i AS (SELECT *, sum(new) OVER (PARTITION BY branch, path ORDER BY ord) AS island FROM m),
r AS (SELECT branch, path, value, min(ord) AS from_ord FROM i GROUP BY branch, path, island, value),
e AS (SELECT *, lead(from_ord) OVER (PARTITION BY branch, path ORDER BY from_ord) - 1 AS until FROM r)
SELECT branch, path, value, from_ord, coalesce(until, head) AS to_ord FROM e JOIN h USING (branch) WHERE value IS NOT NULL""", model=False)
def resource_runs_grown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs kept between batches: the events come in four, each opens, extends and closes what the ones before left; the rows are those of one pass.

    A branch is a type of events, a path its user, a value a band of the event's value, low ones delete.
    """
    band = F.when(F.col("value") >= 20, F.floor(F.col("value") / 25).cast("bigint").cast("string"))
    changes = table(spark, sf_dir, "events").select(F.col("event_type").alias("branch"), F.col("user_id").cast("string").alias("path"), F.col("event_id").alias("ord"), band.alias("value"))
    last = changes.agg(F.max("ord")).first()[0]
    runs = GrowingRuns(spark, f"{shared_dir(spark)}/runs-{uuid.uuid4().hex}")
    for i in range(4 if last is not None else 0):
        runs.update(changes.where((F.col("ord") > i * last // 4 - (i == 0)) & (F.col("ord") <= (i + 1) * last // 4)))
    return runs.read()


@query("""
, s AS (SELECT v, k, name, 1 AS n FROM classes), all_v AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS ord FROM versions),
b AS (SELECT k, c.v, name, ord, lag(ord) OVER w AS before, lag(name) OVER w AS old, lead(ord) OVER w AS later FROM classes c JOIN all_v USING (v) WINDOW w AS (PARTITION BY k ORDER BY ord)), l AS (SELECT max(ord) AS last FROM all_v)
SELECT k::VARCHAR AS path, ord, name AS value FROM b WHERE before IS NULL OR before <> ord - 1 OR old IS DISTINCT FROM name
UNION ALL SELECT k::VARCHAR, ord + 1, NULL FROM b, l WHERE ord < last AND (later IS NULL OR later <> ord + 1)""")
def listing_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full listings of each version made into the changes between them: new and changed values, and what went."""
    order = versions(spark, sf_dir).select("v", (F.dense_rank().over(Window.orderBy("v")) - 1).cast("long").alias("ord"))  # the versions are few
    c = classes(spark, sf_dir).join(F.broadcast(order), "v").select(F.lit("all").alias("branch"), "ord", F.col("k").cast("string").alias("path"), F.col("name").alias("value"))
    return changes_of(c, order.select(F.lit("all").alias("branch"), "ord")).select("path", "ord", "value")
