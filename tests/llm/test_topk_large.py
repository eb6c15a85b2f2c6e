"""Top-k by inner product with components of any finite size, against Python's integers."""

from __future__ import annotations

import math
import random

from pyspark.sql import functions as F

from verspan.llm import topk

SCHEMA = "vec_id long, embedding array<double>, id int, v string, large string, score int"


def brute(rows, is_query, k, scale=topk.SCALE):
    fine = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) and math.isfinite(scale * x) for x in v)]
    first = {}
    for i, v in fine:
        if is_query(i):
            first[i] = min(first.get(i, v), v)
    out = []
    for i, q in first.items():
        found = sorted(((-sum(a * b for a, b in zip(q, v)), j) for j, v in fine if j != i and len(v) == len(q)))[:k]
        out += [(i, r + 1, j, min(max(-s, topk.LONG_MIN), topk.LONG_MAX)) for r, (s, j) in enumerate(found)]
    return sorted(out)


def search(spark, rows, k=3):
    df = spark.createDataFrame([(i, v, 1, "v", "l", 2) for i, v in rows], SCHEMA)
    return sorted(tuple(r) for r in topk.top_k(df, F.col("id") % 2 == 0, k=k).collect())


def test_large_components(spark):
    """Sums beyond a long, ties among them, signs; large rows as queries and as candidates."""
    rng, rows = random.Random(5), [(1, [1e30, 1.0]), (2, [1e30, 1.0]), (3, [-1e30, 1.0]), (4, [1e30, 2.0]), (5, [1e300, 0.0]), (6, [-1e300, 0.0]), (7, [0.5, 0.25]), (8, [3e5, -1.0]), (9, [1e306, 0.0]), (10, [2.0**20, 2.0**20])]
    rows += [(20 + i, [rng.choice([1.0, 1e3, 1e6, 1e9, 1e12]) * rng.uniform(-1, 1) for _ in range(2)]) for i in range(60)]
    assert search(spark, rows, 5) == brute(rows, lambda i: i % 2 == 0, 5)


def test_repeated_queries_and_empty_table(spark):
    rows = [(2, [1.0, 0.0]), (2, [0.0, 1.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0]), (3, [1.0, 1.0]), (4, []), (6, []), (None, [1.0, 1.0]), (5, None), (7, [None, 1.0]), (8, [1.0]), (9, [float("nan"), 0.0])]
    assert search(spark, rows) == brute(rows, lambda i: i % 2 == 0, 3)
    assert search(spark, []) == []
