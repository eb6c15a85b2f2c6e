"""Full-text search over rows: tokens, BM25, phrases, prefixes, fallback, paging; ``verspan.store.search_index`` keeps them."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), 0)


def row_stats(rows: DataFrame, row_id: str, text: str) -> DataFrame:
    return rows.select(F.col(row_id).alias("row"), F.size(tokens(F.coalesce(F.col(text), F.lit("")))).cast("long").alias("dl"))


def corpus_stats(rows: DataFrame, row_id: str, text: str) -> DataFrame:
    """(n, avgdl): rows and their mean length."""
    return row_stats(rows, row_id, text).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def term_frequency(text: Column, phrase: str, prefix: bool = False) -> Column:
    """How often the text holds the phrase; ``prefix``: its last token is a prefix.

    Shifted copies of the tokens are zipped, so that a phrase is one pass over them.
    """
    words = re.findall(r"[^\W_]+", phrase.lower())
    last = len(words) - 1
    one = lambda t, j: F.coalesce(t.startswith(words[j]) if prefix and j == last else t == words[j], F.lit(False))
    if last == 0:
        return F.size(F.filter(tokens(text), lambda t: one(t, 0))).cast("long")
    shifted = F.arrays_zip(*[F.slice(tokens(text), j + 1, 1 << 30).alias(f"t{j}") for j in range(len(words))])
    return F.size(F.filter(shifted, lambda z: reduce(lambda x, y: x & y, [one(z[f"t{j}"], j) for j in range(len(words))]))).cast("long")


def phrase_tf(rows: DataFrame, row_id: str, text: str, phrase: str, prefix: bool = False) -> DataFrame:
    """(row, tf) of the rows that hold the phrase."""
    return rows.select(F.col(row_id).alias("row"), term_frequency(F.coalesce(F.col(text), F.lit("")), phrase, prefix).alias("tf")).where("tf > 0")


def bm25(rows: DataFrame, row_id: str, text: str, phrases: list[tuple[str, bool]]) -> DataFrame:
    """(row, score) of rows that hold all phrases (text, prefix).

    One projection gives lengths and frequencies, one aggregation of it the corpus
    figures, a single row that is broadcast; nothing is shuffled by row or token.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    hits = rows.select(F.col(row_id).alias("row"), F.size(tokens(t)).cast("long").alias("dl"), *[term_frequency(t, p, prefix).alias(f"tf{i}") for i, (p, prefix) in enumerate(phrases)])
    corpus = hits.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(phrases))])
    score = F.lit(0.0)
    for i in range(len(phrases)):
        tf, df = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.greatest(F.log((F.col("n") - df + 0.5) / (df + 0.5)), F.lit(LEAST_IDF))
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    found = reduce(lambda x, y: x & y, [F.col(f"tf{i}") > 0 for i in range(len(phrases))])
    return hits.where(found).join(F.broadcast(corpus)).select("row", score.alias("score"))


def squash(score: Column) -> Column:
    return F.abs(score) / (1 + F.abs(score))


def contains(text: Column, query: str) -> Column:
    """LIKE '%query%' without regard to case."""
    return text.ilike(f"%{query}%")


def with_fallback(primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """The fallback only if the primary result is empty, decided within one plan."""
    any_hit = primary.limit(1).agg(F.count("*").alias("_any"))
    return primary.unionByName(fallback.join(F.broadcast(any_hit)).where("_any = 0").drop("_any"))


def page(hits: DataFrame, order: list[Column | str], limit: int, offset: int = 0) -> DataFrame:
    return hits.orderBy(*order).offset(offset).limit(limit)
