"""Queries of full-text search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verspan.operators import search as X
from verspan.plans.bindings import table
from verspan.plans.registry import query
from verspan.shared import derived
from verspan.store.search_index import SearchIndex

_TOKENS = """
WITH t AS (SELECT doc_id, source, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+') AS ts FROM documents),
c AS (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM t)"""


def _score(tf: str, df: str) -> str:
    return f"greatest(ln((n - {df} + 0.5) / ({df} + 0.5)), 1e-6) * {tf} * 2.2 / ({tf} + 1.2 * (0.25 + 0.75 * dl / avgdl))"


def text_index(spark: SparkSession, sf_dir: str, force: bool = False) -> SearchIndex:
    """The index of the documents, built where there is none yet."""
    docs = table(spark, sf_dir, "documents").select(F.lit(CORPUS).alias("version"), F.col("doc_id").alias("row"), "text")
    index = SearchIndex(spark, derived(spark, "text-index", f"{sf_dir}/documents.parquet"), ["text"])
    index.build(docs, [CORPUS], force)
    return index


#: The documents are one corpus, so one version of the index.
CORPUS = "documents"


@query("SELECT 'documents' AS version, count(*) AS n, sum(len(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+')))::BIGINT AS tokens FROM documents", model=False)
def search_index_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Builds the stored index anew and returns what its registry says: rows and tokens of each version."""
    built = text_index(spark, sf_dir, force=True).versions()
    return spark.createDataFrame([(v, b["n"], sum(b["lens"])) for v, b in built.items()], "version string, n long, tokens long")


@query(_TOKENS + f""",
h AS (SELECT doc_id, len(ts) AS dl, len([x FOR x IN ts IF x LIKE 'the%']) AS tf FROM t), d AS (SELECT count(*) AS df FROM h WHERE tf > 0)
SELECT doc_id, round({_score('tf', 'df')}, 6) AS score FROM h, c, d WHERE tf > 0""", model=False)
def search_bm25_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_index(spark, sf_dir).bm25(CORPUS, [("the", True)], exact=True).select(F.col("row").alias("doc_id"), F.round("score", 6).alias("score"))


@query(_TOKENS + f""",
h AS (SELECT doc_id, len(ts) AS dl, len([i FOR i IN generate_series(1, len(ts) - 1) IF ts[i] = 'of' AND ts[i + 1] = 'the']) AS tf FROM t), d AS (SELECT count(*) AS df FROM h WHERE tf > 0)
SELECT doc_id, tf::BIGINT AS tf, round({_score('tf', 'df')}, 6) AS score FROM h, c, d WHERE tf > 0""", model=False)
def search_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_index(spark, sf_dir).bm25(CORPUS, [("of the", False)], exact=True).select(F.col("row").alias("doc_id"), F.col("tf0").alias("tf"), F.round("score", 6).alias("score"))


@query(_TOKENS + f""",
h AS (SELECT doc_id, len(ts) AS dl, len([x FOR x IN ts IF x = 'with']) AS t1, len([x FOR x IN ts IF x LIKE 'er%']) AS t2 FROM t), d AS (SELECT count(*) FILTER (t1 > 0) AS d1, count(*) FILTER (t2 > 0) AS d2 FROM h)
SELECT doc_id, round({_score('t1', 'd1')} + {_score('t2', 'd2')}, 6) AS score FROM h, c, d WHERE t1 > 0 AND t2 > 0""", model=False)
def search_multi_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_index(spark, sf_dir).bm25(CORPUS, [("with", False), ("er", True)], exact=True).select(F.col("row").alias("doc_id"), F.round("score", 6).alias("score"))


@query("SELECT p_partkey AS k, p_name AS name FROM part WHERE p_name ILIKE '%idge%' OR p_brand ILIKE '%idge%'", model=False)
def search_like_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No token is 'idge': the substring search answers."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("name"), "p_brand")
    hit = p.join(X.phrase_tf(p, "k", "name", "idge").select(F.col("row").alias("k")), "k", "left_semi")
    return X.with_fallback(hit.select("k", "name"), p.where(X.contains(F.col("name"), "idge") | X.contains(F.col("p_brand"), "idge")).select("k", "name"))


@query(_TOKENS + f""",
owners AS (SELECT source FROM (SELECT source, count(*) AS n FROM t WHERE source LIKE 'src1%' GROUP BY source) ORDER BY n DESC, source LIMIT 5),
h AS (SELECT doc_id, source, len(ts) AS dl, len([x FOR x IN ts IF x LIKE 'and%']) AS tf FROM t), d AS (SELECT count(*) AS df FROM h WHERE tf > 0)
SELECT doc_id, source, round({_score('tf', 'df')}, 6) AS score FROM h, c, d WHERE tf > 0 AND source IN (SELECT source FROM owners)""", model=False)
def search_owner_member(spark: SparkSession, sf_dir: str) -> DataFrame:
    """owner#member: the best owners first, then members whose owner is among them."""
    docs = table(spark, sf_dir, "documents")
    owners = docs.where("source like 'src1%'").groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source").limit(5)
    hits = text_index(spark, sf_dir).bm25(CORPUS, [("and", True)], exact=True).select("row", "score").withColumnRenamed("row", "doc_id")
    return hits.join(docs.select("doc_id", "source"), "doc_id").join(owners, "source", "left_semi").select("doc_id", "source", F.round("score", 6).alias("score"))


@query(_TOKENS + f""",
h AS (SELECT doc_id, len(ts) AS dl, len([x FOR x IN ts IF x LIKE 'the%']) AS tf FROM t), d AS (SELECT count(*) AS df FROM h WHERE tf > 0),
s AS (SELECT doc_id, {_score('tf', 'df')} AS score FROM h, c, d WHERE tf > 0 AND doc_id % 3 = 1)
SELECT doc_id, round(score / (1 + score), 6) AS score FROM s ORDER BY round(score, 9) DESC, doc_id LIMIT 10""", model=False)
def search_version_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows alive at a version are kept before the top k is taken."""
    docs = table(spark, sf_dir, "documents")
    alive = docs.where("doc_id % 3 = 1").select(F.col("doc_id").alias("row"))
    hits = text_index(spark, sf_dir).bm25(CORPUS, [("the", True)], exact=True).join(alive, "row", "left_semi")
    return X.page(hits, [F.round("score", 9).desc(), F.col("row")], 10).select(F.col("row").alias("doc_id"), F.round(X.squash(F.col("score")), 6).alias("score"))


@query("""
WITH r AS (SELECT 0 AS kind, p_partkey AS id, p_name AS name FROM part UNION ALL SELECT 1, c_custkey, c_name FROM customer UNION ALL SELECT 2, s_suppkey, s_name FROM supplier),
h AS (SELECT *, len(regexp_extract_all(lower(name), '[\\p{L}\\p{N}]+')) AS dl FROM r WHERE name ILIKE '%red%' OR name ILIKE '%00001%')
SELECT kind, id, name FROM h ORDER BY kind, dl, id LIMIT 20 OFFSET 5""", model=False)
def search_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three kinds of rows in one ranked page: kind, length, id."""
    p = table(spark, sf_dir, "part").select(F.lit(0).alias("kind"), F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    c = table(spark, sf_dir, "customer").select(F.lit(1), "c_custkey", "c_name")
    s = table(spark, sf_dir, "supplier").select(F.lit(2), "s_suppkey", "s_name")
    h = p.union(c).union(s).where(X.contains(F.col("name"), "red") | X.contains(F.col("name"), "00001"))
    return X.page(h, ["kind", F.size(X.tokens(F.col("name"))), "id"], 20, 5).select("kind", "id", "name")


@query(_TOKENS + f""",
runs AS (SELECT doc_id, doc_id % 7 AS from_ord, doc_id % 7 + doc_id % 3 AS to_ord FROM documents),
h AS (SELECT doc_id, len(ts) AS dl, len([x FOR x IN ts IF x = 'is']) AS t1, len([x FOR x IN ts IF x = 'on']) AS t2 FROM t), d AS (SELECT count(*) FILTER (t1 > 0) AS d1, count(*) FILTER (t2 > 0) AS d2 FROM h),
s AS (SELECT doc_id, {_score('t1', 'd1')} + {_score('t2', 'd2')} AS score FROM h, c, d WHERE t1 > 0 AND t2 > 0)
SELECT doc_id, 'v' || from_ord AS from_v, 'v' || to_ord AS to_v, round(score, 6) AS score FROM s JOIN runs USING (doc_id) WHERE 4 BETWEEN from_ord AND to_ord ORDER BY round(score, 9) DESC, doc_id LIMIT 15""", model=False)
def search_resource_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content alive at a point, ranked, with the ends of its interval by name."""
    from verspan.operators.spans import at_point

    docs = table(spark, sf_dir, "documents")
    runs = at_point(docs.select(F.col("doc_id").alias("row"), (F.col("doc_id") % 7).alias("from_ord"), (F.col("doc_id") % 7 + F.col("doc_id") % 3).alias("to_ord")), 4)
    hits = text_index(spark, sf_dir).bm25(CORPUS, [("is", False), ("on", False)], exact=True).join(runs, "row")
    name = lambda c: F.concat(F.lit("v"), F.col(c).cast("string")).alias(c.replace("ord", "v"))
    return X.page(hits, [F.round("score", 9).desc(), F.col("row")], 15).select(F.col("row").alias("doc_id"), name("from_ord"), name("to_ord"), F.round("score", 6).alias("score"))


@query("SELECT p_partkey AS k, p_name AS name FROM part WHERE p_name ILIKE '%lue%' AND split_part(p_name, ' ', -1) = 'bolt' OR p_name LIKE 'red w%' ORDER BY p_partkey LIMIT 40", model=False)
def like_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_name")
    hit = X.contains(n, "lue") & (F.substring_index(n, " ", -1) == "bolt") | n.startswith("red w")
    return table(spark, sf_dir, "part").where(hit).select(F.col("p_partkey").alias("k"), n.alias("name")).orderBy("k").limit(40)


@query(_TOKENS + ", k AS (SELECT DISTINCT doc_id, unnest(ts) AS token FROM t), f AS (SELECT token, count(*) AS df FROM k GROUP BY token) SELECT token, df, n, round(avgdl, 6) AS avgdl FROM f, c WHERE df >= 100", model=False)
def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    df = docs.select(F.explode(F.array_distinct(X.tokens(F.coalesce("text", F.lit(""))))).alias("token")).groupBy("token").agg(F.count("*").alias("df")).where("df >= 100")
    return df.join(F.broadcast(X.corpus_stats(docs, "doc_id", "text"))).select("token", "df", "n", F.round("avgdl", 6).alias("avgdl"))


@query("""
WITH t AS (SELECT doc_id, regexp_extract_all(strip_accents(lower(coalesce(text, ''))), '[\\p{L}\\p{N}]+') AS ts FROM documents), h AS (SELECT doc_id, len(ts) AS dl, len([x FOR x IN ts IF x LIKE 'uber%']) AS t1, len([x FOR x IN ts IF x = 'e']) AS t2 FROM t)
SELECT doc_id, dl, t1 AS tf0, t2 AS tf1 FROM h WHERE t1 > 0 OR t2 > 0""", model=False)
def search_folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters with diacritics are found by the plain ones and the other way round."""
    return text_index(spark, sf_dir).hits(CORPUS, [("Über", True), ("é", False)]).withColumnRenamed("row", "doc_id")
