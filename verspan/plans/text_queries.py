"""Queries on texts, files and ingestion."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verspan.operators import linediff as L
from verspan.operators import search as X
from verspan.plans.bindings import table
from verspan.plans.registry import query

#: The position that tokens are looked up at, in characters.
POSITION = 1200


def _successive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive documents of one source and language as versions of one text."""
    d = table(spark, sf_dir, "documents")
    w = Window.partitionBy("source", "lang").orderBy("doc_id")
    return d.select("doc_id", F.concat_ws("/", "source", "lang").alias("path"), F.lag("text").over(w).alias("old"), F.col("text").alias("new"))


@query()
def line_diff_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _successive(spark, sf_dir)
    return d.select("doc_id", L.patch_column(F.col("path"), F.col("old"), F.col("new")).alias("patch"))


@query("""
WITH c AS (SELECT doc_id, '@Override' || chr(10) || 'void run(' || lang || ') {' || chr(10) || replace(text, '(', '[') || chr(10) || '}' || chr(10) || 'void other() { }' || chr(10) AS code FROM documents),
l AS (SELECT doc_id, string_split(replace(replace(code, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10))[:-2] AS ls FROM c),
u AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i, len(ls) AS n FROM l),
d AS (SELECT *, sum(CASE WHEN i > 1 THEN len(replace(line, '}', '')) - len(replace(line, '{', '')) ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS depth FROM u),
e AS (SELECT doc_id, coalesce(min(i) FILTER (i > 1 AND depth <= 0), max(n)) AS stop FROM d GROUP BY doc_id),
t AS (SELECT doc_id, (sum(len(line)) + any_value(stop) - 1)::INTEGER AS chars FROM d JOIN e USING (doc_id) WHERE i <= stop GROUP BY doc_id)
SELECT documents.doc_id, chars FROM documents LEFT JOIN t USING (doc_id)""", model=False)
def function_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("@Override\nvoid run("), F.col("lang"), F.lit(") {\n"), F.replace("text", F.lit("("), F.lit("[")), F.lit("\n}\nvoid other() { }\n")).alias("code"))
    return d.select("doc_id", F.length(L.slice_column(F.col("code"), "a/B#run")).alias("chars"))


@query()
def blame_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return L.blame_lines(d.withColumn("path", F.concat_ws("/", "source", "lang")), "path", "doc_id", "text").groupBy("path", "version").agg(F.count("*").alias("lines"))


@query("""
WITH p AS (SELECT page_id, split_part(split_part(url, '://', 2), '?', 1) AS path FROM pages), s AS (SELECT page_id, string_split(path, '/') AS parts FROM p)
SELECT prefix, count(DISTINCT page_id) AS pages FROM (SELECT page_id, unnest([array_to_string(parts[1:i], '/') FOR i IN generate_series(1, len(parts))]) AS prefix FROM s) GROUP BY prefix""", model=False)
def package_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every prefix of every path with the pages below it."""
    parts = F.split(F.substring_index(F.substring_index("url", "://", -1), "?", 1), "/", -1)
    p = table(spark, sf_dir, "pages").select("page_id", parts.alias("parts"))
    prefixes = F.transform(F.sequence(F.lit(1), F.size("parts")), lambda i: F.array_join(F.slice("parts", 1, i), "/"))
    return p.select("page_id", F.explode(prefixes).alias("prefix")).groupBy("prefix").agg(F.countDistinct("page_id").alias("pages"))


@query("""
WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS ts FROM documents),
o AS (SELECT doc_id, unnest(ts) AS token, generate_subscripts(ts, 1) AS i FROM t),
p AS (SELECT doc_id, token, coalesce(sum(length(token) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM o)
SELECT doc_id, token, start, start + length(token) AS stop FROM p WHERE 1200 BETWEEN start AND start + length(token)""", model=False)
def token_at_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens that hold a position, ends included; offsets over tokens joined by single blanks."""
    d = table(spark, sf_dir, "documents").select("doc_id", X.tokens(F.col("text")).alias("ts"))
    empty = F.struct(F.lit(0).cast("long").alias("at"), F.lit(None).cast("array<struct<token:string,start:bigint>>").alias("hit"))
    # one pass over the tokens that keeps the few which hold the position
    found = F.aggregate("ts", empty, lambda a, t: F.struct(
        (a["at"] + F.length(t) + 1).alias("at"),
        F.when((a["at"] <= POSITION) & (a["at"] + F.length(t) >= POSITION), F.concat(F.coalesce(a["hit"], F.array()), F.array(F.struct(t.alias("token"), a["at"].alias("start"))))).otherwise(a["hit"]).alias("hit")))
    d = d.select("doc_id", F.explode(found["hit"]).alias("x")).select("doc_id", "x.token", "x.start")
    return d.withColumn("stop", F.col("start") + F.length("token"))


@query("""
WITH n AS (SELECT 'g/' || replace(n_name, ' ', '_') AS owner, 'g/R' || n_regionkey AS supertype FROM nation)
SELECT owner, 1057 AS access, supertype, kind, name, descriptor FROM n, (VALUES ('field', 'area', 'I'), ('method', 'rule', '(I)V')) m(kind, name, descriptor)""", model=False)
def classfile_decls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class files made of the nation table: owner, supertypes and members read back from their bytes."""
    from verspan.sources.classfile import read_declarations, simple_class

    def made(batches):
        for b in batches:
            files = [simple_class(f"g/{name}", f"g/R{region}", [("area", "I")], [("rule", "(I)V")]) for name, region in zip(b.column("name").to_pylist(), b.column("region").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(files, pa.binary())], ["content"])

    n = table(spark, sf_dir, "nation").select(F.replace("n_name", F.lit(" "), F.lit("_")).alias("name"), F.col("n_regionkey").alias("region")).mapInArrow(made, "content binary")
    return read_declarations(n, "content").select("owner", "access", F.get("supertypes", F.lit(0)).alias("supertype"), F.explode("members").alias("m")).select("owner", "access", "supertype", "m.*")


def _linked_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class files made of the nation table: each extends another, calls a third's method and makes a lambda of its own."""
    from verspan.sources.classfile import simple_class

    def made(batches):
        for b in batches:
            files = [simple_class(f"g/N{k}", f"g/N{k // 5}", [], [("rule", "(I)V"), ("lambda$rule$0", "()V")], [(f"g/N{(k + 1) % 25}", "rule", "(I)V")], handles=[(f"g/N{k}", "rule", "(I)V")]) for k in b.column("n_nationkey").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(files, pa.binary())], ["content"])

    return table(spark, sf_dir, "nation").select("n_nationkey").mapInArrow(made, "content binary")


_NATIONS = "WITH n AS (SELECT 'g/N' || n_nationkey AS c, 'g/N' || n_nationkey // 5 AS p, 'g/N' || (n_nationkey + 1) % 25 AS t FROM nation)"


@query(_NATIONS + """, s AS (SELECT unnest([NULL, 'lambda$rule$0']) AS syn)
SELECT c AS ref_owner, NULL::VARCHAR AS ref_member, NULL::VARCHAR AS ref_descriptor, p AS owner, NULL::VARCHAR AS member, NULL::VARCHAR AS descriptor, 'class' AS kind, NULL::VARCHAR AS ref_synthetic FROM n WHERE p <> c
UNION ALL SELECT c, 'rule', '(I)V', t, 'rule', '(I)V', 'call', syn FROM n, s
UNION ALL SELECT c, 'rule', '(I)V', t, NULL, NULL, 'call', syn FROM n, s
UNION ALL SELECT c, 'rule', '(I)V', c, 'rule', '(I)V', 'call', syn FROM n, s""", model=False)
def classfile_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of class files: headers, calls, method references; a lambda's count as its method's."""
    from verspan.sources.classfile import read_references

    return read_references(_linked_classes(spark, sf_dir))


@query(_NATIONS + """, d AS (SELECT * FROM (VALUES ('rule', '(I)V'), ('lambda$rule$0', '()V')) x(member, descriptor))
SELECT c AS owner, member, substr(sha256(concat_ws(chr(10), descriptor, '184 {' || t || '} rule (I)V', '186 run (){java/lang/Runnable} {java/lang/invoke/LambdaMetafactory} metafactory ()V {' || c || '} rule (I)V', '177')), 1, 16) AS hash FROM n, d""", model=False)
def classfile_body_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash of each method of class files over its instructions by name."""
    from verspan.functions.text import body_hash
    from verspan.sources.classfile import read_bodies

    b = read_bodies(_linked_classes(spark, sf_dir))
    return b.groupBy("owner", "member").agg(body_hash(F.collect_list(F.struct("descriptor", "body"))).alias("hash"))


@query("""
SELECT 'file' || r_regionkey AS path, 'class' AS kind, 'r' || r_regionkey AS owner, NULL AS descriptor, 'r' || r_regionkey AS official, 'class_' || r_regionkey AS intermediary, 'geo/R' || r_regionkey AS named FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation)
UNION ALL SELECT 'file' || n_regionkey, 'method', 'r' || n_regionkey, '()I', 'm' || n_nationkey, 'method_' || n_nationkey, n_name FROM nation""", model=False)
def tiny_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mapping text made of the nation table, parsed by lines with the class carried forward."""
    from verspan.sources.tiny import parse_tiny

    n = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_join(F.sort_array(F.collect_list(F.format_string("\tm\t()I\tm%s\tmethod_%s\t%s", F.col("n_nationkey").cast("string"), F.col("n_nationkey").cast("string"), "n_name"))), "\n").alias("ms"))
    t = n.select(F.concat(F.lit("file"), F.col("n_regionkey").cast("string")).alias("path"), F.concat(F.lit("tiny\t2\t0\tofficial\tintermediary\tnamed\n"), F.format_string("c\tr%s\tclass_%s\tgeo/R%s\n", *[F.col("n_regionkey").cast("string")] * 3), F.col("ms")).alias("value"))
    return parse_tiny(t).select("path", "kind", "owner", "descriptor", *[F.col("names")[n].alias(n) for n in ("official", "intermediary", "named")])


@query("SELECT year(o_orderdate)::BIGINT AS v, count(*) AS n FROM orders GROUP BY 1", model=False)
def ingest_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders ingested by a file stream with replaced partitions, read back and counted by year."""
    from verspan.streaming.ingest import ingest

    return ingest(spark, sf_dir).groupBy("v").agg(F.count("*").alias("n"))
