"""Ordered operators: spans of equal state, runs of a change log, points in intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(rows: DataFrame, by: list[str], order: list[str], state: list[str]) -> DataFrame:
    """Add ``island``: a number that grows where the state differs from the row before (null equals null)."""
    w = Window.partitionBy(*by).orderBy(*order)
    now = F.struct(*state)
    new = F.when(F.lag(F.lit(1)).over(w).isNull() | ~now.eqNullSafe(F.lag(now).over(w)), 1).otherwise(0)
    return rows.withColumn("_new", new).withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def collapse(rows: DataFrame, by: list[str], order: str, state: list[str], extra: list[Column] | None = None) -> DataFrame:
    """One row for each span of equal state: by, state, from_v, to_v, versions."""
    marked = islands(rows, by, [order], state)
    return marked.groupBy(*by, "island", *state).agg(F.min(order).alias("from_v"), F.max(order).alias("to_v"), F.count("*").alias("versions"), *(extra or [])).drop("island")


def dense(entities: DataFrame, versions: DataFrame, rows: DataFrame, on: list[str]) -> DataFrame:
    """Every entity at every version, rows joined where there are any: absent versions are states too.

    The versions are few: they go to each entity as one broadcast array.
    """
    all_v = versions.agg(F.sort_array(F.collect_set(versions.columns[0])).alias("_vs"))
    grid = entities.join(F.broadcast(all_v)).select(*entities.columns, F.explode("_vs").alias(versions.columns[0]))
    return grid.join(rows, on, "left")


def runs(changes: DataFrame, path: list[str], order: str, value: str, last: Column) -> DataFrame:
    """Intervals (from_ord, to_ord) of each value in a change log; a null value closes, live runs end at ``last``."""
    changed = islands(changes, path, [order], [value]).groupBy(*path, "island", value).agg(F.min(order).alias("from_ord"))
    w = Window.partitionBy(*path).orderBy("from_ord")
    return changed.withColumn("to_ord", F.coalesce(F.lead("from_ord").over(w) - 1, last)).where(F.col(value).isNotNull()).select(*path, value, "from_ord", "to_ord")


def at_point(intervals: DataFrame, point: int) -> DataFrame:
    return intervals.where((F.col("from_ord") <= point) & (F.col("to_ord") >= point))


def interval_diff(intervals: DataFrame, path: list[str], value: str, old: int, new: int) -> DataFrame:
    """(path, change) between two points of interval tables."""
    a = at_point(intervals, old).select(*path, F.col(value).alias("old_value"))
    b = at_point(intervals, new).select(*path, F.col(value).alias("new_value"))
    change = F.when(F.col("old_value").isNull(), "added").when(F.col("new_value").isNull(), "removed").when(F.col("old_value") != F.col("new_value"), "modified")
    return a.join(b, path, "full").withColumn("change", change).where("change is not null")


def last_seen(rows: DataFrame, by: list[str], order: list[str], when: Column, value: str, out: str) -> DataFrame:
    """Carry the last value of the rows that satisfy ``when`` forward, the current row included."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(out, F.last(F.when(when, F.col(value)), ignorenulls=True).over(w))


def directory(paths: DataFrame, prefix: str, path: str = "path") -> DataFrame:
    """Direct children of a directory: directories first, then files (name, is_dir)."""
    p = f"{prefix.strip('/')}/" if prefix.strip("/") else ""
    inside = paths.where(F.col(path).startswith(p)).select(F.substring(F.col(path), len(p) + 1, 1 << 20).alias("rest"))
    name = F.substring_index("rest", "/", 1)
    return inside.select(name.alias("name"), F.contains("rest", F.lit("/")).alias("is_dir")).where("name <> ''").distinct()
