"""Side indexes: rows of a (version, namespace) pair by owner, built once a pair.

A pair's rows lie in buckets of the owner's hash, sorted by owner; the registry of
``PartStore`` says which pairs are built, and is written only after their rows. A look-up
by owners reads their buckets only; a pair that is not built is named, for the caller to scan.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verspan.store.parts import PartStore

BUCKETS = 64


def pair(version: str, ns: str) -> str:
    return f"{version}|{ns}"


class SideIndex:
    """schema: of the rows, with version_id and ns; key: the column that is looked up."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, buckets: int = BUCKETS):
        self.key, self.buckets = key, buckets
        self.columns = [f.name for f in T.StructType.fromDDL(schema)]
        self.store = PartStore(spark, path, f"{schema}, pair string, bucket int", "pair", ["bucket"], [key])

    def _bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def build(self, rows: DataFrame, pairs: Iterable[tuple[str, str]], force: bool = False) -> list[tuple[str, str]]:
        """Builds the pairs that are not built yet and returns them."""
        todo = {pair(*p): p for p in pairs}
        missing = self.store.missing(todo, force)
        placed = rows.select(*self.columns, F.concat_ws("|", "version_id", "ns").alias("pair"), self._bucket(F.col(self.key)).alias("bucket"))
        self.store.write(placed, missing)
        return [todo[p] for p in missing]

    def has(self, version: str, ns: str) -> bool:
        return pair(version, ns) in self.store.built()

    def rows(self, versions: Iterable[str], ns: str, keys: list[str] | None = None) -> tuple[DataFrame, list[str]]:
        """Rows of the versions that are built, of some keys only if given, and the versions that aren't.

        The buckets are constants of the plan, so that folders are pruned before anything is read.
        """
        built, versions = self.store.built(), list(versions)
        found = self.store.read([pair(v, ns) for v in versions])
        if keys is not None:
            found = found.where(F.col("bucket").isin([self._bucket(F.lit(k)) for k in keys]) & F.col(self.key).isin(keys)) if keys else found.limit(0)
        return found.select(*self.columns), [v for v in versions if pair(v, ns) not in built]
