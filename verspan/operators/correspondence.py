"""Correspondence of naming schemes: full outer joins, coalescing merges, lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verspan.functions.text import map_types


def first_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    r = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_r", r).where("_r = 1").drop("_r")


def outer_join(sources: list[tuple[str, DataFrame]], key: str) -> DataFrame:
    """N-way full outer join on ``key``; each source keeps its one other column under its own name."""
    out = None
    for name, df in sources:
        one = df.select(key, F.col(next(c for c in df.columns if c != key)).alias(name))
        out = one if out is None else out.join(one, key, "full")
    return out


def presence(yarn: Column, intermediary: Column, mojmap: Column) -> Column:
    left = yarn.isNotNull() | intermediary.isNotNull()
    return F.when(left & mojmap.isNotNull(), "both").when(mojmap.isNotNull(), "mojmap_only").otherwise("yarn_only")


def null_safe_join(a: DataFrame, b: DataFrame, strict: list[str], safe: list[str], how: str = "full") -> DataFrame:
    """Join on equal ``strict`` and null-safe equal ``safe`` columns; key columns coalesced, others kept."""
    x, y = a.select(*[F.col(c).alias(f"a_{c}") if c in strict + safe else F.col(c) for c in a.columns]), b.select(*[F.col(c).alias(f"b_{c}") if c in strict + safe else F.col(c) for c in b.columns])
    on = [F.col(f"a_{c}") == F.col(f"b_{c}") for c in strict] + [F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")) for c in safe]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    keys = [F.coalesce(f"a_{c}", f"b_{c}").alias(c) for c in strict + safe]
    return x.join(y, cond, how).select(*keys, *[c for c in a.columns if c not in strict + safe], *[c for c in b.columns if c not in strict + safe])


def merge_coalesce(sources: list[DataFrame], keys: list[str], values: list[str]) -> DataFrame:
    """Column by column the first non-null value in the order of the sources."""
    out = None
    for i, s in enumerate(sources):
        one = s.select(*keys, *values, F.lit(i).alias("_i"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy(*keys).agg(*[F.min_by(v, F.when(F.col(v).isNotNull(), F.col("_i"))).alias(v) for v in values])


def with_missing(declared: DataFrame, more: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``more`` whose key is not declared, beside the declared ones."""
    return declared.unionByName(more.join(declared.select(*keys), keys, "left_anti"))


def unique_or_null(rows: DataFrame, by: list[str], value: str, out: str) -> DataFrame:
    """The value if exactly one row of the group has one, else null."""
    return rows.groupBy(*by).agg(F.when(F.count("*") == 1, F.max(value)).alias(out))


def first_found(lookups: list[DataFrame], keys: list[str]) -> DataFrame:
    """Of several lookups the first, in their order, that has the key; ties within one by all columns."""
    out = None
    for i, d in enumerate(lookups):
        one = d.withColumn("_p", F.lit(i))
        out = one if out is None else out.unionByName(one)
    return first_wins(out, keys, ["_p", *[c for c in lookups[0].columns if c not in keys]]).drop("_p")


def qualified(owner: Column, member: Column) -> Column:
    return F.when(owner.isNotNull() & member.isNotNull(), F.concat(owner, F.lit("#"), member))


def decorated(scanned: DataFrame, mapping: DataFrame, namespace: str = "intermediary") -> DataFrame:
    """Scanned members (owner, name, descriptor, ...) with ``intermediary_name`` and ``intermediary_desc``, null where the mapping has none.

    mapping: rows of ``parse_tiny`` whose first namespace is what the scanned names are in. Of members
    that share owner, name and descriptor the last by its names counts. Descriptors are renamed by the
    mapping's classes, a map of one version's names.
    """
    to = F.coalesce(F.try_element_at("names", F.lit(namespace)), F.element_at(F.map_values("names"), -1))
    own = F.element_at(F.map_values("names"), 1)
    classes = mapping.where("kind = 'class'").where(to.isNotNull()).groupBy(own.alias("c")).agg(F.max(to).alias("t"))
    maps = classes.agg(F.map_from_entries(F.collect_list(F.struct("c", "t"))).alias("_map"))
    members = mapping.where("kind <> 'class'").groupBy("owner", own.alias("name"), "descriptor").agg(F.max(to).alias("intermediary_name"))
    members = members.where("owner is not null and name is not null and descriptor is not null").withColumn("_hit", F.lit(True))
    out = scanned.join(members, ["owner", "name", "descriptor"], "left").join(F.broadcast(maps))  # one row: the names of one version's classes
    return out.withColumn("intermediary_desc", F.when(F.col("_hit"), map_types(F.col("descriptor"), F.col("_map")))).drop("_map", "_hit")


def official_as_mojmap(rows: DataFrame) -> DataFrame:
    """Rows of a version whose official names are the real ones: they are its mojmap names, and it is present on both sides."""
    out = rows.withColumn("mojmap_name", F.col("obf_name"))
    return out.withColumn("presence", F.lit("both")) if "presence" in rows.columns else out
