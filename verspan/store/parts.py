"""A table kept in parts, each built once, with a registry of what is built.

A build writes the rows of some parts below ``data/build=<id>`` and, once they are all
there, appends a row for each part to the registry: part, build and what was counted while
the rows were written. Readers follow the registry only, so that a build that was torn
leaves nothing that is read; its parts are still missing and the next run writes them
anew. A part that is built again is read from its last build. The registry has one small
row for each build of a part and is read on the driver; the data is not.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

REGISTRY = "part string, build string, at long, counts string"
#: Parts of one build at most: each part's counts are columns of its plan.
AT_ONCE = 64


class PartStore:
    """part: the column whose values are the parts; sub: columns that partition a part's files; order: how rows lie in a file."""

    def __init__(self, spark: SparkSession, path: str, schema: str | T.StructType, part: str, sub: Iterable[str] = (), order: Iterable[str] = ()):
        self.spark, self.path, self.part = spark, path.rstrip("/"), part
        self.sub, self.order = list(sub), list(order)
        fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        inner = [f for f in fields if f.name not in (part, *self.sub)]
        self.columns = [f.name for f in fields]
        self._seen: tuple[list[str], dict[str, dict]] = [], {}
        self.schema = T.StructType([*inner, T.StructField("build", T.StringType()), *(fields[c] for c in (part, *self.sub))])

    # the registry

    def built(self) -> dict[str, dict]:
        """Each part's last build and its counts; read again only if the registry has grown."""
        conf, folder = self.spark.sparkContext._jsc.hadoopConfiguration(), self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/registry")
        fs = folder.getFileSystem(conf)
        files = sorted(f.getPath().getName() for f in fs.listStatus(folder)) if fs.exists(folder) else []
        if files != self._seen[0]:
            rows = self.spark.read.schema(REGISTRY).parquet(f"{self.path}/registry").orderBy("at", "build").collect() if files else []  # a row for each build of a part
            self._seen = files, {r["part"]: {"build": r["build"], **json.loads(r["counts"])} for r in rows}
        return self._seen[1]

    def missing(self, parts: Iterable[str], force: bool = False) -> list[str]:
        have = {} if force else self.built()
        return [p for p in dict.fromkeys(parts) if p not in have]

    # rows

    def write(self, rows: DataFrame, parts: Iterable[str], counts: dict[str, Column] | None = None, lie: bool = False) -> list[str]:
        """Builds these parts from the rows that belong to them, a part without rows too.

        lie: each task writes the rows that it has, none are shuffled; a task then has a file in each folder of its rows.
        counts: conditions whose rows are counted for each part while they are written, in the stage that
        writes, where a task that is run again counts once.
        """
        parts = list(dict.fromkeys(parts))
        if not parts:
            return []
        if len(parts) > AT_ONCE:
            return [p for i in range(0, len(parts), AT_ONCE) for p in self.write(rows, parts[i : i + AT_ONCE], counts, lie)]
        build, seen = uuid.uuid4().hex, Observation()
        keys = [self.part, *self.sub]
        rows = rows.select(*self.columns).where(F.col(self.part).isin(parts))
        if not lie:
            rows = rows.hint("rebalance", *keys)  # AQE splits what is large and joins what is small
        asked = {"rows": F.lit(True), **(counts or {})}
        told = {f"{i}:{name}": F.count_if((F.col(self.part) == p) & c).alias(f"{i}:{name}") for i, p in enumerate(parts) for name, c in asked.items()}
        rows.observe(seen, *told.values()).sortWithinPartitions(*keys, *self.order).write.partitionBy(*keys).option("compression", "zstd").parquet(f"{self.path}/data/build={build}")
        found = seen.get
        self.register(build, {p: {name: found[f"{i}:{name}"] for name in asked} for i, p in enumerate(parts)})
        return parts

    def register(self, build: str, counts: dict[str, dict]) -> None:
        rows = [(p, build, time.time_ns(), json.dumps(c)) for p, c in counts.items()]
        self.spark.createDataFrame(rows, REGISTRY).coalesce(1).write.mode("append").parquet(f"{self.path}/registry")

    def read(self, parts: Iterable[str] | None = None) -> DataFrame:
        """The rows of built parts, by partition filters on build and part."""
        have = self.built()
        wanted = have if parts is None else {p: have[p] for p in parts if p in have}
        by_build: dict[str, list[str]] = {}
        for p, b in wanted.items():
            if b.get("rows") != 0:
                by_build.setdefault(b["build"], []).append(p)
        if not by_build:
            return self.spark.createDataFrame([], T.StructType([f for f in self.schema if f.name != "build"])).select(*self.columns)
        rows = self.spark.read.schema(self.schema).option("basePath", f"{self.path}/data").parquet(*[f"{self.path}/data/build={b}" for b in by_build])
        own = [(F.col("build") == b) & F.col(self.part).isin(ps) for b, ps in by_build.items()]
        return rows.where(reduce(lambda x, y: x | y, own)).select(*self.columns)

    def clean(self) -> None:
        """Deletes builds that no part is read from: torn ones and those that were built again."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        data = jvm.org.apache.hadoop.fs.Path(f"{self.path}/data")
        fs, used = data.getFileSystem(conf), {b["build"] for b in self.built().values()}
        if fs.exists(data):
            for s in fs.listStatus(data):
                if s.getPath().getName().partition("=")[2] not in used:
                    fs.delete(s.getPath(), True)
