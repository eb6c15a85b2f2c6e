"""Reference edges: multiplicity, differences between versions and pairing of moves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def multiplicity(edges: DataFrame, keys: list[str], out: str = "cnt") -> DataFrame:
    return edges.groupBy(*keys).agg(F.count("*").alias(out))


def sites(edges: DataFrame, site: list[str], target: str) -> DataFrame:
    """Set of targets of each call site, as an ordered array."""
    return edges.groupBy(*site).agg(F.sort_array(F.collect_set(target)).alias("targets"))


def one_sided(edges: DataFrame, site: list[str], target: str) -> DataFrame:
    """(side, site, targets) of the sites that only one side has; edges have ``side``, old or new.

    Both sides' sets of targets come from one aggregation by site.
    """
    of = lambda side: F.sort_array(F.collect_set(F.when(F.col("side") == side, F.col(target))))
    both = edges.groupBy(*site).agg(F.count_if(F.col("side") == "old").alias("_old"), F.count_if(F.col("side") == "new").alias("_new"), of("old").alias("_o"), of("new").alias("_n"))
    old = F.col("_new") == 0
    return both.where("_old = 0 or _new = 0").select(F.when(old, "old").otherwise("new").alias("side"), *site, F.when(old, F.col("_o")).otherwise(F.col("_n")).alias("targets"))


def pair_moves(changed: DataFrame, site: list[str], rounds: list[list[str]]) -> DataFrame:
    """Pair old with new sites where the round's columns are unique on both sides; the paired leave: (old, new, round).

    changed: (side, site, targets), read once a round, so best stored. Rounds are in order; a key pairs
    only with itself, so that order inside a round doesn't matter. A round is one aggregation, by which
    a key that very many sites share is counted before it is shuffled; only pairs are joined back.
    """
    out, own = None, F.struct(*site)
    for i, keys in enumerate(rounds):
        of = lambda side: (F.count_if(F.col("side") == side).alias(f"_{side}"), F.max(F.when(F.col("side") == side, own)).alias(side))
        pairs = changed.groupBy(*keys).agg(*of("old"), *of("new")).where("_old = 1 and _new = 1").select("old", "new", F.lit(i + 1).cast("long").alias("round"))
        out = pairs if out is None else out.unionByName(pairs)
        if i + 1 < len(rounds):
            paired = pairs.select(F.explode(F.array(*[F.struct(F.lit(side).alias("side"), *[F.col(f"{side}.{c}").alias(c) for c in site]) for side in ("old", "new")])).alias("p")).select("p.*")
            changed = changed.join(paired, ["side", *site], "left_anti")
    return out
