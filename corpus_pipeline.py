"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``documents``. What a stage returns is written as Parquet and
read again before the next one, so that a lost executor repeats one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verspan.llm.common import stored, table
from verspan.llm.decontaminate import without_contaminated
from verspan.llm.jaccard_join import MAX_BROADCAST_IDS, jaccard_classes
from verspan.llm.langid import UND, fit, identify
from verspan.llm.line_dedup import dedup_lines
from verspan.llm.packing import pack

#: Near duplicates: words of a shingle, per cent of the union.
SHINGLE, PERCENT = 5, 80


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (no text or no letter) go."""
    found = identify(docs, fit(docs), keep=docs.columns)
    return found.where(F.col("lang_pred") != UND).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share go; n_chars follows."""
    out = dedup_lines(docs)
    return out.withColumn("text", F.col("kept_text")).withColumn("n_chars", F.char_length("kept_text").cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the smallest id stays.

    Rows that share an id are one class: of those of the smallest id the first in order
    of text and then of the other columns stays, nulls first.
    """
    classes = stored(jaccard_classes(docs, k=SHINGLE, percent=PERCENT).where("doc_id is not null"), "classes")
    drop = stored(classes.where("doc_id <> component_id").select("doc_id").distinct(), "drop")
    drop = F.broadcast(drop) if drop.count() <= MAX_BROADCAST_IDS else drop
    out = docs.join(drop, "doc_id", "left_anti").select(*docs.columns)
    again = stored(classes.groupBy("doc_id").count().where("count > 1").select("doc_id"), "again")
    if again.isEmpty():
        return out
    order = ["text", *(c for c in docs.columns if c not in ("text", "doc_id"))]
    first = out.join(again, "doc_id").groupBy("doc_id").agg(F.min(F.struct(*order)).alias("first")).select("doc_id", "first.*").select(*docs.columns)
    return out.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(first)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their sequence and offset."""
    return pack(docs)


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", packing),
]
#: Language ID and tokenising are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
