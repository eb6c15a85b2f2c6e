"""Benchmark decontamination by spaced seeds.

Tokens are words without their outer punctuation, lower-cased. Fixed masks over a
window of ``SPAN`` tokens keep some positions and ignore the others, so that a hash of
the kept ones survives substitutions at the ignored ones; the masks together let any
single substitution in a window pass, and most pairs of them. Hashes of all test
windows are joined with those of all training windows. Around each hit the two texts
are laid over each other at the hit's offset, and the overlap is grown in both
directions as long as it stays tolerably equal; it counts if ``share`` of its tokens
or more are equal and it covers ``MIN_TOKENS`` tokens, or the whole item if that is
shorter, and ``cover`` of the item. Items shorter than a window have one seed, their
whole text.

The benchmark's distinct texts are joined in chunks of bounded size, each broadcast and
each against all documents; documents are not shuffled. Items of equal text share their
seeds; the ids are joined to what was found.

Defined cases: a null or empty text holds nothing; an item without words matches
nothing; a null id of a document or an item is carried as null; rows that repeat are
reported once for each (document id, item id) with their largest overlap; documents
of no item are not in the result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verspan.llm.common import hashed, map_texts, mixed, multipliers, table

#: Fixed masks: positions that count in a window of SPAN tokens.
SPAN = 8
MASKS = ("11101101", "10110111", "11011011", "01111110")
#: An overlap's least length in tokens, its least share of equal tokens, and its least part of an item.
MIN_TOKENS, SHARE, COVER = 13, 0.8, 0.5
#: Bytes of benchmark text in a broadcast chunk.
CHUNK_BYTES = 8 << 20
PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_KEPT = [np.flatnonzero(np.frombuffer(m.encode(), np.uint8) == ord("1")) for m in MASKS]


def tokens(text: str | None) -> np.ndarray:
    """Word hashes; what is only punctuation is no word."""
    if not text:
        return np.empty(0, np.uint64)
    return hashed([w for w in [w.strip(PUNCTUATION) for w in text.lower().encode().split()] if w])


def seeds(w: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashes, positions of the first token that counts) for each mask; tokens fewer than a window give none."""
    n = len(w) - SPAN + 1
    if n < 1:
        return
    m = multipliers(SPAN)
    at = np.arange(n)
    for i, kept in enumerate(_KEPT):
        h = np.full(n, i + 1, np.uint64)
        for j in kept:
            h += w[j : j + n] * m[j]
        yield mixed(h), at + int(kept[0])


def short_seed(w: np.ndarray) -> int:
    return int(mixed(np.array([(w * multipliers(len(w))).sum(dtype=np.uint64) + np.uint64(len(w) << 8)]))[0])


def overlap(doc: np.ndarray, item: np.ndarray, shift: int, at: int, share: float) -> tuple[int, int, int]:
    """(start in the item, length, equal tokens) of the best tolerable overlap around item position ``at``; shift: document minus item position.

    Equal tokens score by the weight that makes ``share`` of them break even, so the
    overlap is the maximal segment through the hit.
    """
    lo, hi = max(0, -shift), min(len(item), len(doc) - shift)
    same = item[lo:hi] == doc[lo + shift : hi + shift]
    gain = np.where(same, 1 - share, -share)
    c = np.r_[0.0, np.cumsum(gain)]
    k = at - lo
    end = k + 1 + int(len(c) - 2 - k - np.argmax(c[k + 1 :][::-1]))  # the longest of the best
    start = int(np.argmin(c[: k + 1]))
    return lo + start, end - start, int(same[start:end].sum())


class Benchmark:
    """Seeds of a chunk of items, sorted by hash."""

    def __init__(self, rows: list[tuple[int | None, str]], share: float = SHARE, cover: float = COVER, min_tokens: int = MIN_TOKENS):
        self.share, self.cover, self.min_tokens = share, cover, min_tokens
        self.ids, self.items, hashes, which, at = [], [], [], [], []
        self.short: dict[int, dict[int, list[int]]] = {}
        for i, text in rows:
            w = tokens(text)
            if not len(w):
                continue
            k = len(self.items)
            self.ids.append(i)
            self.items.append(w)
            if len(w) < SPAN:
                self.short.setdefault(len(w), {}).setdefault(short_seed(w), []).append(k)
            for h, p in seeds(w):
                hashes.append(h)
                which.append(np.full(len(h), k, np.int32))
                at.append(p.astype(np.int32))
        h = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        by = np.argsort(h, kind="stable")
        self.hashes = h[by]
        self.which = (np.concatenate(which) if which else np.empty(0, np.int32))[by]
        self.at = (np.concatenate(at) if at else np.empty(0, np.int32))[by]
        #: A bit for each hash's low 22 bits: most training windows end here.
        self.maybe = np.zeros(1 << 22, np.bool_)
        self.maybe[(self.hashes & np.uint64((1 << 22) - 1)).astype(np.int64)] = True

    def found(self, w: np.ndarray) -> dict[int, tuple[int, int, int, int]]:
        """Verified overlaps of a document: item -> (equal, length, start in the document, item's tokens)."""
        out: dict[int, tuple[int, int, int, int]] = {}
        hits = set()
        for h, p in seeds(w):
            own = np.flatnonzero(self.maybe[(h & np.uint64((1 << 22) - 1)).astype(np.int64)])
            if not len(own):
                continue
            lo, hi = np.searchsorted(self.hashes, h[own], "left"), np.searchsorted(self.hashes, h[own], "right")
            for a, b, x in zip(lo.tolist(), hi.tolist(), p[own].tolist()):
                hits.update((int(self.which[i]), x - int(self.at[i]), int(self.at[i])) for i in range(a, b))
        done: dict[tuple[int, int], int] = {}
        for k, shift, at in sorted(hits):
            if at < done.get((k, shift), -1):
                continue  # inside an overlap already seen
            start, length, equal = overlap(w, self.items[k], shift, at, self.share)
            done[k, shift] = max(at + 1, start + length)
            n = len(self.items[k])
            if length >= min(self.min_tokens, n) and length >= self.cover * n and equal >= self.share * length and (equal, length) > out.get(k, (0, 0))[:2]:
                out[k] = (equal, length, start + shift, n)
        for n, known in self.short.items():
            m = multipliers(n)
            if len(w) >= n:
                h = np.full(len(w) - n + 1, n << 8, np.uint64)
                for j in range(n):
                    h += w[j : j + len(h)] * m[j]
                for x in np.flatnonzero(np.isin(h := mixed(h), np.fromiter(known, np.uint64, len(known)))).tolist():
                    for k in known[int(h[x])]:
                        out.setdefault(k, (n, n, x, n))
        return out


SPANS = "doc_id long, item_id long, equal_tokens long, overlap_tokens long, start_token long, item_tokens long"


def _scan(bench_b):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench = bench_b.value
        for b in batches:
            rows = [(i, bench.ids[k], *v) for i, t in zip(b.column("id").to_pylist(), b.column("text").to_pylist()) for k, v in bench.found(tokens(t)).items()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["doc_id", "item_id", "equal_tokens", "overlap_tokens", "start_token", "item_tokens"])
    return run


def _clean(bench_b, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench = bench_b.value
        for b in batches:
            yield b.filter(pa.array([not bench.found(tokens(t)) for t in b.column(text_col).to_pylist()], pa.bool_()))
    return run


def _keyed(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """Items with the hash of their text; items without text are left out."""
    items = benchmark.select(benchmark[item_col].cast("long").alias("item_id"), benchmark[text_col].alias("text")).where("text is not null")
    return items.withColumn("key", F.xxhash64("text"))


def _chunks(benchmark: DataFrame, item_col: str, text_col: str, share: float, cover: float, min_tokens: int) -> Iterator:
    """Broadcast chunks of the benchmark, each of about CHUNK_BYTES of text at most; one at least."""
    items = _keyed(benchmark, item_col, text_col).select("key", "text").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = -(-size // CHUNK_BYTES) or 1
    for c in range(chunks):
        part = items.where(F.pmod("key", F.lit(chunks)) == c) if chunks > 1 else items
        rows = [(r["key"], r["text"]) for r in part.orderBy("key").collect()]
        yield benchmark.sparkSession.sparkContext.broadcast(Benchmark(rows, share, cover, min_tokens))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", share: float = SHARE, cover: float = COVER, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """The rows of ``docs``, whatever their columns, that hold no overlap with any item."""
    for bench in _chunks(benchmark, item_col, item_text_col, share, cover, min_tokens):
        docs = map_texts(docs, _clean(bench, text_col), docs.schema)
    return docs


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", share: float = SHARE, cover: float = COVER, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """One row for each (document, item) with a verified overlap."""
    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    out = None
    for bench in _chunks(benchmark, item_col, item_text_col, share, cover, min_tokens):
        one = map_texts(rows, _scan(bench), SPANS)
        out = one if out is None else out.union(one)
    best = F.max(F.struct("equal_tokens", "overlap_tokens", (-F.col("start_token")).alias("neg"), "item_tokens")).alias("b")
    ids = _keyed(benchmark, item_col, item_text_col).select("key", F.col("item_id").alias("item")).distinct()
    out = out.withColumnRenamed("item_id", "key").join(ids, "key").withColumnRenamed("item", "item_id")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.equal_tokens", "b.overlap_tokens", (-F.col("b.neg")).alias("start_token"), "b.item_tokens")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
