"""Runs of a change log that grow: later commits open, extend and close runs.

A change says that a path of a branch holds a value from an ordinal on; a null value that
it is gone. Runs that have ended are written once. Runs that are still open lie in buckets
by path without an end: they end where their branch does, so a commit that doesn't touch a
path costs it nothing. A batch reads the open runs of the buckets that it touches, lays its
changes after them, and writes the runs that have ended and the buckets' open runs as they
are now, in one job; then one row in the log makes the batch, its heads and its buckets
valid at once. A batch that was torn has no row and leaves nothing that is read.

Batches come in the order of their ordinals, split anywhere: changes at the head of their
branch are taken, changes before it were taken already and are passed over, so that a batch
that is delivered again changes nothing. Of unlike changes of a path at one ordinal the
greatest value counts, a null last. An empty batch moves heads only.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verspan.operators.spans import islands

BUCKETS = 32
LOG = "at long, batch string, heads string, buckets string"


class GrowingRuns:
    """value_type: the type of values; changes have branch, path, ord and value."""

    def __init__(self, spark: SparkSession, path: str, value_type: str = "string", buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self.schema = f"branch string, path string, value {value_type}, from_ord bigint, to_ord bigint, batch string, state string, bucket int"

    def _log(self) -> list[dict]:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/log")
        if not p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            return []
        rows = self.spark.read.schema(LOG).parquet(f"{self.path}/log").orderBy("at").collect()  # a row for each batch
        return [{"batch": r["batch"], "heads": json.loads(r["heads"]), "buckets": json.loads(r["buckets"])} for r in rows]

    def heads(self) -> dict[str, int]:
        """The last ordinal of each branch."""
        out: dict[str, int] = {}
        for entry in self._log():
            out |= entry["heads"]
        return out

    def _rows(self, batches: list[str]) -> DataFrame | None:
        if not batches:
            return None
        return self.spark.read.schema(self.schema).option("basePath", f"{self.path}/data").parquet(*[f"{self.path}/data/batch={b}" for b in batches])

    def _open(self, log: list[dict], buckets: list[int]) -> DataFrame | None:
        """Open runs of some buckets, each from the last batch that wrote it."""
        last = {b: entry["batch"] for entry in log for b in entry["buckets"]}
        by_batch: dict[str, list[int]] = {}
        for b in buckets:
            if b in last:
                by_batch.setdefault(last[b], []).append(b)
        rows, own = self._rows(list(by_batch)), F.lit(False)
        for batch, bs in by_batch.items():
            own |= (F.col("batch") == batch) & F.col("bucket").isin(bs)
        return rows.where(own & (F.col("state") == "open")) if rows is not None else None

    def update(self, changes: DataFrame, versions: DataFrame | None = None) -> None:
        """Takes a batch of changes; versions: (branch, ord) of the batch, if some have no change."""
        log = self._log()
        heads: dict[str, int] = {}
        for entry in log:
            heads |= entry["heads"]
        ords = (versions if versions is not None else changes).groupBy("branch").agg(F.max("ord").alias("ord")).collect()  # a row for each branch
        now = {r["branch"]: max(r["ord"], heads.get(r["branch"], r["ord"])) for r in ords}
        head = F.create_map(*[F.lit(x) for pair in heads.items() for x in pair]) if heads else F.lit(None).cast("map<string,bigint>")
        fresh = changes.select("branch", "path", F.col("ord").cast("bigint").alias("ord"), "value").where(F.coalesce(F.col("ord") >= F.try_element_at(head, F.col("branch")), F.lit(True)))
        fresh = fresh.groupBy("branch", "path", "ord").agg(F.max("value").alias("value")).withColumn("bucket", F.pmod(F.xxhash64("branch", "path"), F.lit(self.buckets)).cast("int"))
        touched = sorted(r["bucket"] for r in fresh.select("bucket").distinct().collect())  # at most ``buckets``
        batch = uuid.uuid4().hex
        if touched:
            still = self._open(log, touched)
            if still is not None:
                old = still.select("branch", "path", F.col("from_ord").alias("ord"), "value", "bucket")
                fresh = old.unionByName(fresh).groupBy("branch", "path", "ord", "bucket").agg(F.max("value").alias("value"))
            marked = islands(fresh, ["branch", "path"], ["ord"], ["value"]).groupBy("branch", "path", "bucket", "island", "value").agg(F.min("ord").alias("from_ord"))
            after = F.lead("from_ord").over(Window.partitionBy("branch", "path").orderBy("from_ord")) - 1
            runs = marked.withColumn("to_ord", after).where("value is not null").withColumn("state", F.when(F.col("to_ord").isNull(), "open").otherwise("closed"))
            runs = runs.select("branch", "path", "value", "from_ord", "to_ord", "state", "bucket").hint("rebalance", "state", "bucket")
            runs.sortWithinPartitions("state", "bucket", "branch", "path", "from_ord").write.partitionBy("state", "bucket").option("compression", "zstd").parquet(f"{self.path}/data/batch={batch}")
        row = [(time.time_ns(), batch, json.dumps(now), json.dumps(touched))]
        self.spark.createDataFrame(row, LOG).coalesce(1).write.mode("append").parquet(f"{self.path}/log")

    def read(self) -> DataFrame:
        """(branch, path, value, from_ord, to_ord): open runs end at the head of their branch."""
        log, heads = self._log(), self.heads()
        fields = ["branch", "path", "value", "from_ord", "to_ord"]
        closed = self._rows([e["batch"] for e in log if e["buckets"]])
        if closed is None:
            return self.spark.createDataFrame([], self.schema).select(*fields)
        head = F.element_at(F.create_map(*[F.lit(x) for pair in heads.items() for x in pair]), F.col("branch"))
        still = self._open(log, list(range(self.buckets))).withColumn("to_ord", head.cast("bigint"))
        return closed.where("state = 'closed'").select(*fields).unionByName(still.select(*fields))

    def follow(self, source: DataFrame, checkpoint: str) -> None:
        """Takes all that a stream of changes delivers, micro-batch by micro-batch."""
        source.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda batch, _: self.update(batch)).start().awaitTermination()


def changes_of(snapshots: DataFrame, versions: DataFrame) -> DataFrame:
    """(branch, path, ord, value) of full listings (branch, ord, path, value): what differs from the branch's version before.

    versions: (branch, ord) of all versions, those without a file too. One window over a path's versions; the
    version after each, by which absence shows, is joined from the versions, which are few for each branch.
    """
    following = F.lead("ord").over(Window.partitionBy("branch").orderBy("ord"))
    order = versions.select("branch", "ord").distinct().withColumn("next", following)
    w = Window.partitionBy("branch", "path").orderBy("ord")
    seen = snapshots.select("branch", "path", "ord", "value").join(order, ["branch", "ord"]).withColumn("before", F.lag(F.struct("value", "next")).over(w)).withColumn("later", F.lead("ord").over(w))
    came = seen.where(F.col("before").isNull() | (F.col("before.next") != F.col("ord")) | ~F.col("before.value").eqNullSafe(F.col("value"))).select("branch", "path", "ord", "value")
    gone = seen.where("next is not null and (later is null or later <> next)").select("branch", "path", F.col("next").alias("ord"), F.lit(None).cast(dict(snapshots.dtypes)["value"]).alias("value"))
    return came.unionByName(gone)


def blob_kind(path, sample):
    """text, binary or lang: a language file by its path, else by whether the first bytes hold a zero."""
    lang = path.rlike(r"(^|/)lang/[^/]+\.(json|lang)$")
    return F.when(lang, "lang").when(F.locate(chr(0), sample.cast("string")) > 0, "binary").otherwise("text")
