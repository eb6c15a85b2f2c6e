"""What several operators share: the shared folder, word hashes, graph components."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the contracts: space and the control characters 9 to 13.
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words whose hashes a Python worker keeps; only speed depends on it.
WORD_CACHE = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as ``spark.checkpoint.dir`` names it.

    Only where it is unset, as in tests on one machine, a temporary folder is set.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='verspan-')}"
        spark.conf.set("spark.checkpoint.dir", path)
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read again: cuts the lineage for good."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """``stored`` for what nothing reads after the block: its folder is deleted at the end."""
    folder = new_path(spark, "scratch")

    def keep(df: DataFrame, name: str) -> DataFrame:
        path = f"{folder}/{name}-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    try:
        yield keep
    finally:
        remove(spark, folder)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path below the shared folder by Hadoop's file system."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


#: Rows of an Arrow batch that holds texts.
TEXT_ROWS = 2000
_ROWS_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


#: How modules empty what they keep in a worker between tasks.
CACHES: dict[str, Callable[[], object]] = {}


def drop_caches(but: str) -> None:
    """Empties what other modules' tasks have left in this worker: it lives on, and their next task may never come."""
    for module, clear in CACHES.items():
        if module != but:
            clear()
    give_back()


def give_back() -> None:
    """Freed memory goes back to the machine."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def tidy(f: Callable) -> Callable:
    """A worker lives on for tasks of other kinds: a task begins without their caches, and at its end freed memory is given back."""
    module = f.__module__

    def run(batches):
        drop_caches(module)
        try:
            yield from f(batches)
        finally:
            give_back()
    return run


def map_texts(df: DataFrame, f: Callable, schema) -> DataFrame:
    """``mapInArrow`` over rows that hold texts of any length: where the session leaves the rows of an Arrow batch at
    their default, it is set to ``TEXT_ROWS``, so that neither side holds 10,000 texts at once."""
    conf = df.sparkSession.conf
    if conf.get(_ROWS_KEY, None) is None:
        conf.set(_ROWS_KEY, str(TEXT_ROWS))
    return df.mapInArrow(tidy(f), schema)


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of few rows for what runs inside, where a row can be as large as a whole text."""
    old = spark.conf.get(_ROWS_KEY, None)
    spark.conf.set(_ROWS_KEY, str(rows))
    try:
        yield
    finally:
        spark.conf.set(_ROWS_KEY, old) if old is not None else spark.conf.unset(_ROWS_KEY)


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class _Hashes(dict):
    """64-bit hash of a word; the dictionary is emptied when it is full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = _Hashes()


def words(text: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased: bytes.split() splits at just these."""
    return text.lower().split()


def hashed(ws: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_hashes.__getitem__, ws), np.uint64, len(ws))


def texts(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def mixed(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (splitmix)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def multipliers(k: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.full(k, 0x9E3779B97F4A7C15, np.uint64), dtype=np.uint64)


def ngrams(w: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-grams in order, repeats included."""
    m = multipliers(k)
    out = w[: len(w) - k + 1] * m[0]
    for i in range(1, k):
        out += w[i : len(w) - k + 1 + i] * m[i]
    return mixed(out + np.uint64(k))


def signed(a: np.ndarray) -> pa.Array:
    return pa.array(a.view(np.int64))


def packed(a: np.ndarray) -> bytes:
    """Sorted unsigned integers as differences, byte plane by byte plane, so that compression finds the zeros."""
    d = np.diff(a, prepend=a[:1] * 0)
    return d.view(np.uint8).reshape(-1, 8).T.tobytes()


def unpacked(b: bytes) -> np.ndarray:
    planes = np.frombuffer(b, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def components(edges: DataFrame, u: str = "u", v: str = "v", stored: Callable[[DataFrame, str], DataFrame] = stored) -> DataFrame:
    """Connected components: (node, component), component the smallest node reachable.

    Large star and small star in turn until nothing changes; each round is written
    to the shared folder. Minima are taken by aggregation, so a node with very many
    neighbours is pre-aggregated, and joined back by joins that AQE can split.
    Null ends are left out; a loop at a node gives no row; an empty table gives none.
    """
    spark = edges.sparkSession
    e = edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where("u is not null and v is not null and u <> v").distinct()
    e = stored(e, "edges")
    state = None
    while True:
        sym = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = sym.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select("u", "v", "m")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        e = stored(small, "edges")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.countDistinct("u")).first()
        if now == state or now[0] == now[2] and e.join(e.select(F.col("v").alias("u")), "u", "left_semi").isEmpty():
            break
        state = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
