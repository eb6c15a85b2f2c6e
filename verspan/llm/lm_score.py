"""Language-model scoring from a log-frequency Bloom filter.

Training tokens are counted as hashed unigrams and bigrams (64 bits) over all training
documents: each task counts its own, packs sorted keys by bucket, and one worker for
each bucket adds them up. A count c has the level ``1 + floor(log2 c)``; an n-gram is
put into its bucket's shard of the Bloom filter once for each level up to its own.
Each item has ``BITS_PER_ITEM`` bits at every size of the input. Shards of at most
``MAX_BYTES`` together are broadcast; beyond that bound they stay where they are, and
the distinct n-grams of each ``SCORE_AT_ONCE`` tokens are shuffled to them by bucket and
their levels back, with the same results.

A count is read back by probing level after level until one is missing. Scores use
``P(w) = (c(w) + 1) / (N + V + 1)`` interpolated with bigrams (Jelinek and Mercer),
``P(w | v) = SHARE * min(c(vw), c(v)) / c(v) + (1 - SHARE) * P(w)``; a text begins after an end.

The base score needs exact counts: those of the most frequent tokens are broadcast
(``FREQUENT`` of them at most), all others are joined by token.

Defined cases: a null or empty text is one end token; rows that share an id are scored
each; a row without an id trains and is not held out; without training rows all counts
are 0; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verspan.llm.common import hashed, map_texts, mixed, multipliers, packed, partitions, signed, stored, table, texts, tidy, unpacked, words

END = xxhash.xxh3_64_intdigest(b"\n")
SHARE = 0.2
BITS_PER_ITEM, PROBES = 12, 6
#: Bytes of all shards that are broadcast; decides the way of the probes, not their results.
MAX_BYTES = 128 << 20
FREQUENT = 1 << 17
WINDOW = 1_000_000
#: Tokens scored at once.
SCORE_AT_ONCE = 400_000
MAX_LEVEL = 48


def tokens(text: bytes | None) -> np.ndarray:
    """Hashes of the words and of one end."""
    out = hashed(words(text)) if text else np.empty(0, np.uint64)
    return np.append(out, np.uint64(END))


def bigrams(before: np.ndarray, w: np.ndarray) -> np.ndarray:
    m = multipliers(2)
    return mixed(before * m[0] + w * m[1] + np.uint64(2))


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (mixed(keys) % np.uint64(buckets)).astype(np.int64)


def _counted(buckets: int):
    """Blobs (bucket, order, keys, counts) of each task's n-grams."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flushed() -> pa.RecordBatch:
            w = np.concatenate(held)
            before = np.r_[np.uint64(END), w[:-1]]
            out = ([], [], [], [])
            for order, keys in ((1, w), (2, bigrams(before, w))):
                v, c = np.unique(keys, return_counts=True)
                b = bucket_of(v, buckets)
                by = np.argsort(b, kind="stable")
                v, c, b = v[by], c[by].astype(np.uint32), b[by]
                cuts = np.searchsorted(b, np.arange(buckets + 1))
                for i in np.flatnonzero(np.diff(cuts)):
                    x = slice(cuts[i], cuts[i + 1])
                    for o, y in zip(out, (int(i), order, packed(v[x]), c[x].tobytes())):
                        o.append(y)
            return pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, (pa.int32(), pa.int32(), pa.binary(), pa.binary()))], ["bucket", "ord", "keys", "counts"])

        for b in batches:
            for t in texts(b.column("text")):
                held.append(tokens(t))
                size += len(held[-1])
                if size >= WINDOW:
                    yield flushed()
                    held, size = [], 0
        if held:
            yield flushed()
    return run


def _summed(parts: list[tuple[bytes, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    if not parts:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    keys = np.concatenate([unpacked(k) for k, _ in parts])
    counts = np.concatenate([np.frombuffer(c, np.uint32) for _, c in parts]).astype(np.int64)
    by = np.argsort(keys, kind="stable")
    keys, counts = keys[by], counts[by]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(counts, first)


def levels(counts: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log2(counts)).astype(np.int64)


def positions(keys: np.ndarray, level: int, probe: int, bits: np.ndarray | int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = mixed(keys + np.uint64(level) * np.uint64(0xD1B54A32D192ED03))
        return (h + np.uint64(probe) * ((h >> np.uint64(17)) | np.uint64(1))) % np.asarray(bits, np.uint64)


def shard(grams: list[tuple[int, np.ndarray, np.ndarray]], most_bytes: int | None = None) -> bytes:
    """Bits of one bucket; grams: (first level, keys, counts). Only a caller's bound makes it smaller."""
    items = sum(int(np.maximum(levels(c) - f + 1, 0).sum()) for f, _, c in grams)
    bits = items * BITS_PER_ITEM if most_bytes is None else min(items * BITS_PER_ITEM, most_bytes * 8)
    bits = max(64, bits // 64 * 64)
    on = np.zeros(bits, np.bool_)
    for f, keys, counts in grams:
        top = levels(counts)
        level = f
        while len(keys):
            keys, top = keys[top >= level], top[top >= level]
            for p in range(PROBES):
                on[positions(keys, level, p, bits).astype(np.int64)] = True
            level += 1
    return np.packbits(on, bitorder="little").tobytes()


def _reduced(frequent: int):
    """By bucket: its filter shard and totals; its unigrams, the frequent ones apart."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[int, dict[int, list]] = {}
        for b in batches:
            for i, o, k, c in zip(*(b.column(x).to_pylist() for x in ("bucket", "ord", "keys", "counts"))):
                by.setdefault(i, {1: [], 2: []})[o].append((k, c))
        while by:
            i, parts = by.popitem()
            k1, c1 = _summed(parts[1])
            k2, c2 = _summed(parts[2])
            bits = shard([(1, k1, c1), (1, k2, c2)])
            top = np.zeros(len(c1), np.bool_)
            top[np.argsort(-c1, kind="stable")[:frequent]] = True
            rows = [(i, "filter", bits, b"", int(c1.sum()), len(k1)), (i, "frequent", packed(k1[top]), c1[top].tobytes(), 0, 0), (i, "rest", packed(k1[~top]), c1[~top].tobytes(), 0, 0)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.string(), pa.binary(), pa.binary(), pa.int64(), pa.int64()))], ["bucket", "kind", "data", "counts", "n", "v"])
    return run


def climbed(keys: np.ndarray, bits: np.ndarray, size: np.ndarray, base: np.ndarray, first: int = 1) -> np.ndarray:
    """Level of each key by probes of its shard, from the first level up; 0 if that one is missing."""
    out = np.zeros(len(keys), np.uint8)
    at = np.arange(len(keys))
    level = first
    while len(at) and level <= MAX_LEVEL:
        for p in range(PROBES):
            pos = base[at] + positions(keys[at], level, p, size[at]).astype(np.int64)
            at = at[(bits[pos >> 3] >> (pos & 7).astype(np.uint8)) & 1 == 1]
        out[at] = level
        level += 1
    return out


def quantised(level: np.ndarray) -> np.ndarray:
    """The count that a level stands for."""
    return np.where(level == 0, 0.0, np.where(level == 1, 1.0, 2.0 ** (level - 0.5)))


class Model:
    """The filter of all buckets and the exact counts of frequent tokens."""

    def __init__(self, rows, buckets: int):
        self.buckets, self.n, self.v = buckets, 0, 0
        shards = {i: b"\0" * 8 for i in range(buckets)}
        keys, counts = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        for r in rows:
            if r["kind"] == "filter":
                shards[r["bucket"]] = bytes(r["data"])
                self.n += r["n"]
                self.v += r["v"]
            elif len(r["data"]):
                keys.append(unpacked(bytes(r["data"])))
                counts.append(np.frombuffer(bytes(r["counts"]), np.int64))
        self.bits = np.array([8 * len(shards[i]) for i in range(buckets)], np.int64)
        self.base = np.cumsum(self.bits) - self.bits
        self.filter = np.frombuffer(b"".join(shards[i] for i in range(buckets)), np.uint8)
        keys, counts = np.concatenate(keys), np.concatenate(counts)
        by = np.argsort(keys)
        self.keys, self.counts = keys[by], counts[by]

    def count(self, keys: np.ndarray, first: int) -> np.ndarray:
        """Quantised count of each n-gram by membership probes, from the first level up; 0 if that one is missing."""
        b = bucket_of(keys, self.buckets)
        return quantised(climbed(keys, self.filter, self.bits[b], self.base[b], first))

    def score(self, w: np.ndarray, before: np.ndarray) -> np.ndarray:
        """log10 P of each token after the one before it."""
        one, inverse = np.unique(np.concatenate([w, before]), return_inverse=True)
        c = self.count(one, 1)
        c_w, c_before = c[inverse[: len(w)]], c[inverse[len(w) :]]
        return self.mixture(c_w, c_before, self.count(bigrams(before, w), 1))

    def mixture(self, c_w: np.ndarray, c_before: np.ndarray, both: np.ndarray) -> np.ndarray:
        p = (c_w + 1) / (self.n + self.v + 1)
        return np.log10(SHARE * np.minimum(both, c_before) / np.maximum(c_before, 1) + (1 - SHARE) * np.minimum(p, 1))

    def exact(self, w: np.ndarray) -> np.ndarray:
        """Exact counts of frequent tokens, -1 for others."""
        if not len(self.keys):
            return np.full(len(w), -1)
        at = np.minimum(np.searchsorted(self.keys, w), len(self.keys) - 1)
        return np.where(self.keys[at] == w, self.counts[at], -1)


SCORED = "rid long, id long, n_tokens long, known long, logs double, score double, others binary"


def after(w: np.ndarray) -> np.ndarray:
    """The token before each one; each text ends with an end."""
    return np.r_[np.uint64(END), w[:-1]]


def _dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[int], np.ndarray]]:
    """(ids, sizes, tokens) of texts, some ``SCORE_AT_ONCE`` tokens at once."""
    ids, ws, size = [], [], 0
    for b in batches:
        for i, t in zip(b.column("id").to_pylist(), texts(b.column("text"))):
            ids.append(i)
            ws.append(tokens(t))
            size += len(ws[-1])
            if size >= SCORE_AT_ONCE:
                yield ids, [len(x) for x in ws], np.concatenate(ws)
                ids, ws, size = [], [], 0
    if ids:
        yield ids, [len(x) for x in ws], np.concatenate(ws)


def _rows(model: Model, rid: int, ids: list, sizes: list[int], w: np.ndarray, logs_p: np.ndarray) -> pa.RecordBatch:
    """Scores, what frequent tokens add to the base score, and the other tokens with their counts in the text."""
    sizes = np.array(sizes)
    starts = np.cumsum(sizes) - sizes
    score = np.add.reduceat(logs_p, starts)
    one, inverse = np.unique(w, return_inverse=True)
    c = model.exact(one)[inverse]
    logs = np.add.reduceat(np.where(c > 0, np.log10(np.maximum(c, 0) + 1), 0), starts)
    known = np.add.reduceat((c > 0).astype(np.int64), starts)
    rest = np.flatnonzero(c < 0)
    cuts = np.searchsorted(rest, np.r_[starts, len(w)])
    others = [w[rest[a:b]].tobytes() for a, b in zip(cuts, cuts[1:])]
    return pa.RecordBatch.from_arrays([pa.array(np.arange(rid, rid + len(ids))), pa.array(ids, pa.int64()), pa.array(sizes), pa.array(known), pa.array(logs), pa.array(score), pa.array(others, pa.binary())], ["rid", "id", "n_tokens", "known", "logs", "score", "others"])


def _scored(model_b):
    """Rows by the broadcast filter."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, rid = model_b.value, TaskContext.get().partitionId() << 40
        for ids, sizes, w in _dealt(batches):
            yield _rows(model, rid, ids, sizes, w, model.score(w, after(w)))
            rid += len(ids)
    return run


ASKED = "part long, bucket int, ord int, data binary, ids array<long>, sizes array<long>"


def _by_bucket(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(order of sorted keys by bucket, where each bucket begins)."""
    b = bucket_of(keys, buckets)
    by = np.argsort(b, kind="stable")
    return by, np.searchsorted(b[by], np.arange(buckets + 1))


def _asked(buckets: int):
    """Of each part of texts its tokens (order 0) and, by bucket, its distinct n-grams."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 40
        for ids, sizes, w in _dealt(batches):
            rows = [(part, -1, 0, w.tobytes(), ids, sizes)]
            for order, grams in ((1, w), (2, bigrams(after(w), w))):
                keys = np.unique(grams)
                by, cuts = _by_bucket(keys, buckets)
                rows += [(part, int(i), order, packed(keys[by[cuts[i] : cuts[i + 1]]]), None, None) for i in np.flatnonzero(np.diff(cuts))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())))], ["part", "bucket", "ord", "data", "ids", "sizes"])
            part += 1
    return run


def _answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Levels of n-grams; rows by bucket, the shard (order 0) first."""
    held, bits = None, np.zeros(8, np.uint8)
    for b in batches:
        out = []
        for part, bucket, order, data in zip(*(b.column(c).to_pylist() for c in ("part", "bucket", "ord", "data"))):
            if bucket != held:
                held, bits = bucket, np.zeros(8, np.uint8)
            if order == 0:
                bits = np.frombuffer(data, np.uint8)
                continue
            keys = unpacked(data)
            size = np.full(len(keys), 8 * len(bits), np.int64)
            out.append((part, bucket, order, climbed(keys, bits, size, np.zeros(len(keys), np.int64)).tobytes()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int32(), pa.binary()))], ["part", "bucket", "ord", "data"])


def _joined(model_b, buckets: int):
    """Rows of each part by its levels; rows by part, order and bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, rid = model_b.value, TaskContext.get().partitionId() << 40

        def done(ids: list, sizes: list[int], data: bytes, found: dict[int, list[bytes]]) -> pa.RecordBatch:
            w = np.frombuffer(data, np.uint64)
            counts = []
            for order, grams in ((1, w), (2, bigrams(after(w), w))):
                keys, inverse = np.unique(grams, return_inverse=True)
                own = np.empty(len(keys), np.float64)
                own[_by_bucket(keys, buckets)[0]] = quantised(np.frombuffer(b"".join(found[order]), np.uint8).astype(np.int64))
                counts.append(own[inverse])
            before = np.r_[counts[0][-1:], counts[0][:-1]]  # the last token of a part is an end
            return _rows(model, rid, ids, sizes, w, model.mixture(counts[0], before, counts[1]))

        held = None
        for b in batches:
            for order, data, ids, sizes in zip(*(b.column(c).to_pylist() for c in ("ord", "data", "ids", "sizes"))):
                if order == 0:
                    if held:
                        yield done(*held)
                        rid += len(held[0])
                    held = (ids, sizes, data, {1: [], 2: []})
                else:
                    held[3][order].append(data)
        if held:
            yield done(*held)
    return run


def _others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ws = [np.frombuffer(x, np.uint64) for x in b.column("others").to_pylist()]
        sizes = [len(x) for x in ws]
        if sum(sizes):
            rid = np.repeat(b.column("rid").to_numpy(), sizes)
            yield pa.RecordBatch.from_arrays([pa.array(rid), signed(np.concatenate(ws))], ["rid", "h"])


def _unigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for k, c in zip(b.column("data").to_pylist(), b.column("counts").to_pylist()):
            if k:
                yield pa.RecordBatch.from_arrays([signed(unpacked(k)), pa.array(np.frombuffer(c, np.int64))], ["h", "c"])


def score_texts(docs: DataFrame, train: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) of each document."""
    spark = docs.sparkSession
    buckets = max(partitions(spark), 8)
    blobs = map_texts(train.select(train[text_col].alias("text")), _counted(buckets), "bucket int, ord int, keys binary, counts binary")
    reduced = stored(blobs.repartition(buckets, "bucket").mapInArrow(tidy(_reduced(max(1, FREQUENT // buckets))), "bucket int, kind string, data binary, counts binary, n long, v long"), "counts")
    shards = reduced.where("kind = 'filter'")
    whole = (shards.agg(F.sum(F.length("data"))).first()[0] or 0) <= MAX_BYTES
    data = F.col("data") if whole else F.when(F.col("kind") == "frequent", F.col("data")).otherwise(F.lit(b""))
    model = Model(reduced.where("kind <> 'rest'").withColumn("data", data).toLocalIterator(), buckets)  # MAX_BYTES and FREQUENT bound it
    model_b = spark.sparkContext.broadcast(model)
    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    if whole:
        scored = stored(map_texts(rows, _scored(model_b), SCORED), "scored")
    else:
        asked = stored(map_texts(rows, _asked(buckets), ASKED), "asked")
        probes = shards.select(F.lit(-1).cast("long").alias("part"), "bucket", F.lit(0).alias("ord"), "data").union(asked.where("ord > 0").select("part", "bucket", "ord", "data"))
        answers = probes.repartition(buckets, "bucket").sortWithinPartitions("bucket", "ord").mapInArrow(_answered, "part long, bucket int, ord int, data binary")
        back = asked.where("ord = 0").unionByName(answers, allowMissingColumns=True).repartition(buckets, "part").sortWithinPartitions("part", "ord", "bucket")
        scored = stored(back.mapInArrow(_joined(model_b, buckets), SCORED), "scored")
    n, v = model.n, model.v
    rest = reduced.where("kind = 'rest'").select("data", "counts").mapInArrow(_unigrams, "h long, c long")
    others = scored.select("rid", "others").mapInArrow(tidy(_others), "rid long, h long").groupBy("rid", "h").agg(F.count("*").alias("tf"))
    found = others.join(rest, "h").groupBy("rid").agg(F.sum(F.col("tf") * F.log10(F.col("c") + 1)).alias("more"), F.sum("tf").alias("more_known"))
    out = scored.drop("others").join(found, "rid", "left")
    return out.select(F.col("id").alias(id_col), "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
                      (F.col("logs") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * float(np.log10(n + v + 1))).alias("base_score"), "score")


def held_out(id_col, of: int = 7):
    return F.coalesce(F.crc32(id_col.cast("string")) % of == 2, F.lit(False))


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score_texts(docs, docs.where(~held_out(docs["doc_id"])))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
