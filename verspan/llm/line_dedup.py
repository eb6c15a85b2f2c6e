"""Line deduplication by DataFrame functions only.

Lines are normalised, hashed and exploded with their position; distinct documents are
counted for each hash; lines over the threshold go, but for those of one keeper document;
the rest is put together again by position. Only hashes are shuffled for the counts,
never lines. Common lines are broadcast where they are counted to be few, else joined by
shuffles that Spark can split, so that a line found in every document is no task's load.

Defined cases: a null or empty text is one empty line. Documents that share an id
count once, and all of them keep the lines if they are the keeper. A document without
an id keeps its lines and counts for nothing. Other columns are passed through,
whatever their names; the operator's own columns are named by parameters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verspan.llm.common import SPACE, lower_ascii, stored, table

MIN_CHARS, MIN_DOCS = 40, 5
#: Most common lines (20 bytes each) that are broadcast.
MAX_BROADCAST_LINES = 1_000_000


def line_key(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(SPACE)))


def _long_keys(lines: Column, min_chars: int) -> Column:
    """Hashes (96 bits) of the keys of a document's long lines, one for each line; null for short ones."""
    keys = F.transform(lines, line_key)
    return F.transform(keys, lambda k: F.when(F.char_length(k) >= min_chars, F.struct(F.xxhash64(k).alias("h"), F.hash(k).alias("g"))))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS,
                out_col: str = "kept_text", lines_col: str = "n_lines", dropped_col: str = "n_dropped") -> DataFrame:
    """Add the text without its repeated lines, the number of lines, and of those dropped."""
    text = F.coalesce(docs[text_col], F.lit(""))
    # rows that share an id are told apart by their text
    keyed = docs.where(docs[id_col].isNotNull()).select(docs[id_col].alias("id"), F.xxhash64(text).alias("t"), F.posexplode(_long_keys(F.split(text, "\n", -1), min_chars)).alias("pos", "k")).where("k is not null")
    keyed = stored(keyed.select("id", "t", "pos", "k.h", "k.g"), "line-keys")
    common = keyed.select("id", "h", "g").distinct().groupBy("h", "g").agg(F.count("*").alias("n"), F.max("id").alias("keeper")).where(F.col("n") >= min_docs).drop("n")
    common = stored(common, "common-lines")
    held = F.broadcast(common) if common.count() <= MAX_BROADCAST_LINES else common
    drops = keyed.join(held, ["h", "g"]).where("id <> keeper").groupBy("id", "t").agg(F.collect_set("pos").alias("drop"))
    row = docs.select(F.struct(*docs.columns).alias("doc"), docs[id_col].alias("id"), F.xxhash64(text).alias("t"))
    joined = row.join(drops, ["id", "t"], "left")
    lines = F.split(F.coalesce(F.col(f"doc.`{text_col}`"), F.lit("")), "\n", -1)
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("drop"))  # by hash, in order
    kept = F.when(F.col("drop").isNull(), lines).otherwise(F.transform(left, lambda i: F.get(lines, i)))
    out = joined.select("doc", lines.alias("lines"), kept.alias("kept"))
    return out.select(*[F.col(f"doc.`{c}`").alias(c) for c in docs.columns if c not in (out_col, lines_col, dropped_col)],
                      F.array_join("kept", "\n").alias(out_col), F.size("lines").cast("long").alias(lines_col), (F.size("lines") - F.size("kept")).cast("long").alias(dropped_col))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH lines AS (
  SELECT rid, doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos
  FROM (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
common AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT rid, doc_id, line, pos, (c.k IS NOT NULL AND doc_id <> keeper) AS gone FROM keyed LEFT JOIN common c ON keyed.k = c.k)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY rid, doc_id
"""
