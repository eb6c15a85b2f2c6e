"""Exact top-k by inner product over an impact-ordered index, score at a time.

Vectors become integers, floor(scale * x). Each block of candidates is indexed by
(dimension, quantised impact): a posting segment lists the vectors whose component
lies in that level. For a query, the contribution of a level above the least that the
dimension can add gives each segment's impact; segments are processed by descending
impact in rounds, adding to accumulators. What a vector has not yet received is
bounded by the impact of the next segment for each open dimension, plus the
quantisation slack. Processing stops only once the bounds prove that few vectors can
still be among the k best; these possible members are scored exactly, so ties and
results are exact.

Queries reach the workers in chunks of bounded size, each chunk against all candidate
blocks; a block yields its k best only.

Rows with components so large that a sum of products might not fit a long are not
indexed: they are kept as doubles and compared by Python's integers, exactly, as queries
with every row and as candidates with every query. A score that no long holds is
returned as the nearest long; its rank is that of the whole number.

Defined cases: vectors that are null or hold null or non-finite components take no
part, as query or candidate, nor do such whose scaled components no double holds; vectors of unlike lengths are not compared; a query's own
id is no candidate, under repeated rows neither; candidates that repeat a row count
each; of query rows that share an id the smallest vector is taken; a null id takes no
part; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verspan.llm.common import table

SCALE, K = 1024, 10
LEVEL_BITS = 4
#: Rows whose largest component, times the root of their length, reaches this are compared by Python's integers.
LARGE = 1 << 30
LONG_MAX, LONG_MIN = (1 << 63) - 1, -(1 << 63)
#: Candidates of a block; queries of a chunk.
BLOCK, CHUNK = 4096, 20_000
ROUNDS = 12


class Index:
    """Posting segments of a block of integer vectors."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, x
        self.low, high = x.min(0), x.max(0)
        span = (high - self.low).astype(np.float64)
        self.shift = np.maximum(0, np.ceil(np.log2(span + 1)).astype(np.int64) - LEVEL_BITS)
        level = (x - self.low) >> self.shift
        self.top = level.max(0)
        n = 1 << LEVEL_BITS
        order = np.argsort(level, axis=0, kind="stable")
        ranked = np.take_along_axis(level, order, 0)
        self.docs = [order[:, d] for d in range(x.shape[1])]
        self.cuts = [np.searchsorted(ranked[:, d], np.arange(n + 1)) for d in range(x.shape[1])]

    def best(self, q: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, exact scores) of the k best for a query; fewer if there are fewer."""
        n, dims = self.x.shape
        w = np.abs(q)
        # segments (dimension, level counted from the end that adds least)
        d = np.repeat(np.arange(dims), self.top + 1)
        rise = np.concatenate([np.arange(t + 1) for t in self.top])
        impact = (w[d] * rise) << self.shift[d]
        slack = int((w * ((np.int64(1) << self.shift) - 1)).sum())
        go = np.argsort(-impact, kind="stable")
        rounds = np.array_split(go, min(ROUNDS, len(go)))
        score = np.zeros(n, np.int64)
        open_dims = np.full(n, dims)
        alive = self.ids != own
        want = min(k, int(alive.sum()))
        possible = np.flatnonzero(alive)
        if not want:
            return self.ids[:0], score[:0]
        for r, segs in enumerate(rounds):
            lists = []
            for s in segs:
                level = rise[s] if q[d[s]] >= 0 else self.top[d[s]] - rise[s]
                lists.append(self.docs[d[s]][self.cuts[d[s]][level] : self.cuts[d[s]][level + 1]])
            sizes = [len(x) for x in lists]
            at = np.concatenate(lists)
            np.add.at(score, at, np.repeat(impact[segs], sizes))
            open_dims -= np.bincount(at, minlength=n)
            rest = int(impact[rounds[r + 1][0]]) if r + 1 < len(rounds) else 0
            least = score[alive]
            bar = np.partition(least, len(least) - want)[len(least) - want]
            possible = np.flatnonzero(alive & (score + open_dims * rest + slack >= bar))
            if len(possible) <= 4 * k:  # proof that no other can be a member
                break
        exact = self.x[possible] @ q
        by = np.lexsort((self.ids[possible], -exact))[:k]
        return self.ids[possible][by], exact[by]


def _whole(vectors: list[list[float]], scale: int) -> np.ndarray:
    """floor(scale * x) as Python's integers."""
    return np.array([[math.floor(scale * x) for x in v] for v in vectors], object).reshape(len(vectors), -1)


def _beyond(score: int) -> str:
    """Orders scores that are beyond a long's range among each other; empty for others."""
    if LONG_MIN <= score <= LONG_MAX:
        return ""
    digits = str(abs(score))
    if score > 0:
        return f"{len(digits):06d}{digits}"
    return f"{999_999 - len(digits):06d}" + "".join(str(9 - int(c)) for c in digits)


def _exact(ids: np.ndarray, x: np.ndarray, q: np.ndarray, own: int, k: int) -> list[tuple[int, int]]:
    """(id, score) of the k best by Python's integers."""
    other = ids != own
    return sorted(zip(ids[other].tolist(), (x[other] @ q).tolist()), key=lambda r: (-r[1], r[0]))[:k]


def _search(queries_b, k: int, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries: dict[int, list] = {}
        for i, v, large in queries_b.value:
            queries.setdefault(len(v if v is not None else large), []).append((i, v, large))
        for b in batches:
            for s in range(0, b.num_rows, BLOCK):
                own = b.slice(s, BLOCK)
                ids, vectors, large = own.column("id").to_numpy(), own.column("v"), own.column("large")
                is_small, is_large = vectors.is_valid().to_numpy(zero_copy_only=False), large.is_valid().to_numpy(zero_copy_only=False)
                sizes = np.where(is_small, pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(), pc.fill_null(pc.list_value_length(large), 0).to_numpy())
                flat = vectors.flatten().to_numpy()
                starts = np.cumsum(np.where(is_small, sizes, 0)) - np.where(is_small, sizes, 0)
                out: tuple[list, list, list, list] = ([], [], [], [])
                for size in np.unique(sizes):
                    if int(size) not in queries:
                        continue
                    rows, far = np.flatnonzero((sizes == size) & is_small), np.flatnonzero((sizes == size) & is_large)
                    x = flat[starts[rows][:, None] + np.arange(size)]
                    index = Index(ids[rows], x) if size and len(rows) else None
                    far_x = _whole(large.take(pa.array(far)).to_pylist(), scale) if len(far) else None
                    for i, v, q_large in queries[int(size)]:
                        if q_large is not None:
                            q = _whole([q_large], scale)[0]
                            found = _exact(ids[rows], x.astype(object), q, i, k)
                        elif index:
                            found = list(zip(*(a.tolist() for a in index.best(np.array(v, np.int64), i, k))))
                        else:
                            found = [(j, 0) for j in np.sort(ids[rows][ids[rows] != i])[:k].tolist()]
                        if far_x is not None:
                            q = _whole([q_large], scale)[0] if q_large is not None else np.array(v, object)
                            found = sorted(found + _exact(ids[far], far_x, q, i, k), key=lambda r: (-r[1], r[0]))[:k]
                        out[0].extend([i] * len(found))
                        out[1].extend(j for j, _ in found)
                        out[2].extend(min(max(score, LONG_MIN), LONG_MAX) for _, score in found)
                        out[3].extend(_beyond(score) for _, score in found)
                if out[0]:
                    yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.string())], ["query_id", "vec_id", "score", "beyond"])
    return run


def integer_vectors(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(id, v, large): rows that take part, components floor(scale * x) in v; the doubles themselves in large where they are too large for it."""
    v = F.transform(vectors[vec_col], lambda x: x.cast("double"))
    fine = v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x * scale) == float("inf")))
    top = F.coalesce(F.array_max(F.transform(v, lambda x: F.abs(x * scale))), F.lit(0.0)) * F.sqrt(F.size(v).cast("double"))
    small = top < LARGE
    rows = vectors.where(vectors[id_col].isNotNull() & F.coalesce(fine, F.lit(False)))
    return rows.select(vectors[id_col].cast("long").alias("id"), F.when(small, F.transform(v, lambda x: F.floor(x * scale))).alias("v"), F.when(~small, v).alias("large"))


def top_k(vectors: DataFrame, is_query, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K, scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query row; is_query: condition over the integer id column ``id``."""
    rows = integer_vectors(vectors, id_col, vec_col, scale)
    first = F.min(F.struct("v", "large"))
    queries = rows.where(is_query).groupBy("id").agg(first.alias("q")).select("id", "q.v", "q.large")
    chunks = -(-queries.count() // CHUNK) or 1
    found = None
    for i in range(chunks):
        part = queries.where(F.pmod(F.xxhash64("id"), F.lit(chunks)) == i) if chunks > 1 else queries
        sent = vectors.sparkSession.sparkContext.broadcast([(r["id"], r["v"], r["large"]) for r in part.collect()])  # about CHUNK rows
        one = rows.mapInArrow(_search(sent, k, scale), "query_id long, vec_id long, score long, beyond string")
        found = one if found is None else found.union(one)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("beyond"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


ORACLE = r"""
WITH v AS (
  SELECT vec_id, [floor(1024 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_sum([a.v[i] * b.v[i] FOR i IN generate_series(1, len(a.v))])::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v))
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
"""
