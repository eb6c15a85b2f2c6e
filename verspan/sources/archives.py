"""Archives as a data source: one large archive is read by several tasks.

``register(spark)`` makes the format ``archive_entries``; ``load(path)`` gives a row for each
entry of the archives below the path: (path, entry, content). Options: ``pattern``, the
entries' names with wildcards (``*.class``), or ``entries``, some names divided by line
feeds, of which only those are read; ``splitBytes``, the size from which an archive is
dealt out. Partitions are planned from the sizes of the archives alone; each task reads the
archive's directory, takes its share of the entries in the order in which they lie, and
inflates only these. Paths are opened by pyarrow's file systems, a remote one with its own.

    register(spark)
    read_declarations(spark.read.format("archive_entries").load("file:///jars"))
"""

from __future__ import annotations

import fnmatch
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SPLIT_BYTES = 16 << 20
#: Bytes of a batch of entries.
BATCH_BYTES = 4 << 20
ARCHIVES = (".jar", ".zip")


@dataclass
class Share(InputPartition):
    """The ``part``-th of ``parts`` shares of an archive's entries."""

    path: str
    part: int
    parts: int


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.pattern = options["path"], options.get("pattern", "*.class")
        self.entries = frozenset(options["entries"].split("\n")) if "entries" in options else None
        self.split = int(options.get("splitbytes", options.get("splitBytes", SPLIT_BYTES)))

    def partitions(self) -> list[Share]:
        files, at = _open(self.path)
        found = files.get_file_info(at)
        each = [found] if found.is_file else files.get_file_info(pafs.FileSelector(at, recursive=True))
        shares = []
        for f in sorted((f for f in each if f.is_file and f.path.endswith(ARCHIVES)), key=lambda f: f.path):
            parts = max(1, -(-f.size // self.split))
            shares += [Share(f.path, i, parts) for i in range(parts)]
        return shares or [Share("", 0, 0)]

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        if not partition.parts:
            return
        files, _ = _open(self.path)
        with files.open_input_file(partition.path) as file, zipfile.ZipFile(file) as archive:
            entries = sorted((e for e in archive.infolist() if not e.is_dir() and self._wanted(e.filename)), key=lambda e: e.header_offset)
            low, high = (len(entries) * i // partition.parts for i in (partition.part, partition.part + 1))
            names, contents, size = [], [], 0
            for e in entries[low:high]:
                names.append(e.filename)
                contents.append(archive.read(e))
                size += len(contents[-1])
                if size > BATCH_BYTES:
                    yield self._batch(partition.path, names, contents)
                    names, contents, size = [], [], 0
            if names:
                yield self._batch(partition.path, names, contents)

    def _wanted(self, name: str) -> bool:
        return name in self.entries if self.entries is not None else fnmatch.fnmatchcase(name, self.pattern)

    @staticmethod
    def _batch(path: str, names: list[str], contents: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([path] * len(names)), pa.array(names), pa.array(contents, pa.binary())], ["path", "entry", "content"])


class ArchiveEntries(DataSource):
    @classmethod
    def name(cls) -> str:
        return "archive_entries"

    def schema(self) -> str:
        return "path string, entry string, content binary"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ArchiveEntries)


def classes_named(spark: SparkSession, path: str, owners: list[str]) -> DataFrame:
    """The class files of some classes only, from the archives below a path."""
    return spark.read.format(ArchiveEntries.name()).option("entries", "\n".join(f"{o}.class" for o in owners)).load(path)


def headers_above(spark: SparkSession, path: str, owners: list[str]) -> DataFrame:
    """(owner, access, supertypes) of classes and of all that they inherit from, read on demand: each step opens only the supertypes that are new.

    What the archives don't hold ends the walk. The steps are as many as the hierarchy is deep, each of a few names.
    """
    from verspan.sources.classfile import read_declarations

    seen, todo, out = set(), list(dict.fromkeys(owners)), []
    while todo:
        found = read_declarations(classes_named(spark, path, todo)).select("owner", "access", "supertypes").collect()  # headers of one step
        seen.update(todo)
        out += found
        todo = sorted({s for r in found for s in r["supertypes"]} - seen)
    return spark.createDataFrame(out, "owner string, access int, supertypes array<string>")


def hit_counts(spark: SparkSession, path: str, owner: str, at: str) -> DataFrame:
    """(member, descriptor, hits): how often each method of one class, read alone, refers to ``owner[:name[:descriptor]]``; methods without a hit too."""
    from verspan.sources.classfile import read_declarations, read_instructions

    one = classes_named(spark, path, [owner])
    hit = (F.col("target") == at) | F.col("target").startswith(f"{at}:")
    hits = read_instructions(one).where(hit).groupBy("member", "descriptor").agg(F.count("*").alias("hits"))
    methods = read_declarations(one).select(F.explode("members").alias("m")).where("m.kind = 'method'").select(F.col("m.name").alias("member"), "m.descriptor")
    return methods.join(hits, ["member", "descriptor"], "left").select("member", "descriptor", F.coalesce("hits", F.lit(0)).alias("hits"))
