"""Tiny mapping files, versions 1 and 2, as a DataFrame of classes and members."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def parse_tiny(files: DataFrame, path: str = "path", text: str = "value") -> DataFrame:
    """(path, kind, owner, descriptor, names): ``names`` by namespace, owner in the first one.

    Lines are exploded with their number; the class of a version 2 member is carried
    forward within its file. Parameters, comments and unknown lines are left out.
    """
    lines = F.split(F.regexp_replace(F.col(text), "\r\n?", "\n"), "\n", -1)
    rows = files.select(F.col(path).alias("path"), F.split(F.get(lines, F.lit(0)), "\t").alias("head"), F.posexplode(lines).alias("no", "line")).where("no > 0 and line <> ''")
    v2 = F.get("head", F.lit(0)) == "tiny"
    spaces = F.when(v2, F.slice("head", 4, F.size("head"))).otherwise(F.slice("head", 2, F.size("head")))
    cells = F.split("line", "\t", -1)
    rows = rows.select("path", "no", v2.alias("v2"), spaces.alias("spaces"), cells.alias("cells"))
    first = F.get("cells", F.lit(0))
    second = F.get("cells", F.lit(1))
    kind = F.when(F.col("v2"), F.when(first == "c", "class").when((first == "") & (second == "m"), "method").when((first == "") & (second == "f"), "field")).otherwise(F.when(first == "CLASS", "class").when(first == "METHOD", "method").when(first == "FIELD", "field"))
    rows = rows.withColumn("kind", kind).where("kind is not null")
    is_class = F.col("kind") == "class"
    carried = F.last(F.when(is_class, second), ignorenulls=True).over(Window.partitionBy("path").orderBy("no").rowsBetween(Window.unboundedPreceding, 0))
    owner = F.when(is_class | ~F.col("v2"), second).otherwise(carried)
    descriptor = F.when(~is_class, F.get("cells", F.lit(2)))
    names = F.when(is_class, F.slice("cells", 2, F.size("spaces"))).otherwise(F.slice("cells", 4, F.size("spaces")))
    names = F.map_from_arrays("spaces", F.transform(F.sequence(F.lit(0), F.size("spaces") - 1), lambda i: F.nullif(F.get(names, i), F.lit(""))))
    return rows.select("path", "kind", owner.alias("owner"), descriptor.alias("descriptor"), names.alias("names"))
