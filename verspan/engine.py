"""The query interface over symbol tables.

An ``Engine`` holds DataFrames with the schemas of ``verspan.schema`` and answers as
DataFrames. Version filters come first in every plan, so that tables partitioned by
version are pruned; single decisions about versions (which identity two of them share,
which one is the latest) read the small versions table on the driver.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verspan import schema
from verspan.functions.text import body_hash, content_type, map_types, real_name, rename_types, types_in
from verspan.operators import correspondence as C
from verspan.operators import diff as D
from verspan.operators import graph as G
from verspan.operators import references as R
from verspan.operators import search as X
from verspan.operators import spans as S
from verspan.shared import stored
from verspan.store.parts import PartStore
from verspan.store.search_index import SearchIndex
from verspan.store.side_index import SideIndex

#: Namespaces and the columns that hold them, with their other spellings.
NAMESPACES = {"yarn": "yarn_name", "named": "yarn_name", "mojmap": "mojmap_name", "intermediary": "intermediary_name", "obf": "obf_name", "obfuscated": "obf_name", "official": "obf_name"}

#: The columns of names that are searched, beside the simple name.
SEARCHED = ["yarn_name", "mojmap_name", "intermediary_name", "obf_name"]

#: What is searched, as it is stored beside its index.
ELEMENTS = "version_id string, kind_rank int, kind string, id bigint, owner_id bigint, simple_name string, " + ", ".join(f"{n} string" for n in SEARCHED)

#: All resources are one corpus.
RESOURCES = "resources"

#: The most entries of one request, by what it asks.
CAPS = {"queries": 25, "post queries": 50, "body": 2000, "versions": 60, "scanned versions": 25, "targets": 50, "classes": 25, "depth": 5}


class QueryError(ValueError):
    """A request that can't be answered: unknown version, namespace or parameter."""

    def __init__(self, message: str, status: int = 400):
        super().__init__(message)
        self.status = status


def capped(values: list, what: str) -> list:
    """The values, if they are no more than one request may ask for."""
    if len(values) > CAPS[what]:
        raise QueryError(f"at most {CAPS[what]} {what}")
    return values


def capped_rows(keys: DataFrame, what: str = "body") -> DataFrame:
    """The keys of a request's body, if they are no more than it may hold."""
    if keys.limit(CAPS[what] + 1).count() > CAPS[what]:
        raise QueryError(f"at most {CAPS[what]} keys")
    return keys


def column_of(ns: str, fallback: str | None = None) -> str:
    if ns in NAMESPACES:
        return NAMESPACES[ns]
    if fallback:
        return NAMESPACES[fallback]
    raise QueryError(f"unknown namespace {ns!r}")


def split_owner_member(q: str) -> tuple[str, str] | None:
    """owner#member, owner.member or owner/Member; None for a plain query or a class path."""
    at = max(q.rfind("#"), q.rfind("."))
    if 0 < at < len(q) - 1:
        return q[:at], q[at + 1 :]
    at = q.rfind("/")
    if 0 < at < len(q) - 1:
        owner, member = q[:at], q[at + 1 :]
        if not (owner.rpartition("/")[2][:1].islower() and member[:1].isupper()):
            return owner, member
    return None


@dataclass
class Engine:
    spark: SparkSession
    versions: DataFrame
    classes: DataFrame
    members: DataFrame
    decls: DataFrame | None = None
    refs: DataFrame | None = None
    runs: DataFrame | None = None
    source_files: DataFrame | None = None
    source_text: DataFrame | None = None
    bodies: DataFrame | None = None
    instructions: DataFrame | None = None
    contents: DataFrame | None = None
    translations: DataFrame | None = None
    index: SearchIndex | None = None
    elements: PartStore | None = None
    decl_index: SideIndex | None = None
    ref_index: SideIndex | None = None
    resource_versions: DataFrame | None = None
    content_index: SearchIndex | None = None
    translation_index: SearchIndex | None = None

    # side indexes

    def build_side_indexes(self, path: str, pairs: list[tuple[str, str]], force: bool = False) -> dict[str, list[tuple[str, str]]]:
        """Builds declarations and references of (version, namespace) pairs that are not built below ``path`` yet, and reads there from now on."""
        out = {}
        if self.decls is not None:
            self.decl_index = SideIndex(self.spark, f"{path}/decls", schema.DECLS, "owner")
            out["decls"] = self.decl_index.build(self.decls, pairs, force)
        if self.refs is not None:
            self.ref_index = SideIndex(self.spark, f"{path}/refs", schema.REFS, "owner")
            out["refs"] = self.ref_index.build(self.refs, pairs, force)
        return out

    def _side(self, index: SideIndex | None, whole: DataFrame, versions: list[str], ns: str, owners: list[str] | None) -> DataFrame:
        """Rows of versions, of some owners only if given: from the index where it has them, by a scan where not."""
        found, rest = index.rows(versions, ns, owners) if index else (None, versions)
        if not rest:
            return found
        scan = whole.where(F.col("version_id").isin(rest) & (F.col("ns") == ns))
        scan = scan if owners is None else scan.where(F.col("owner").isin(owners))
        return scan if found is None else found.unionByName(scan.select(*found.columns))

    def _decls(self, version_id: str, ns: str, owners: list[str] | None = None) -> DataFrame:
        return self._side(self.decl_index, self.decls, [version_id], ns, owners)

    def _refs(self, versions: list[str], ns: str, owners: list[str] | None = None) -> DataFrame:
        return self._side(self.ref_index, self.refs, versions, ns, owners)

    # versions

    def ordered_versions(self) -> DataFrame:
        rank = F.row_number().over(Window.orderBy(F.asc_nulls_last("sort_index"), "version_id")) - 1  # the versions table is small
        return self.versions.withColumn("rank", rank)

    def list_versions(self, include_variants: bool = True, releases_only: bool = False, release_type: str | None = None, id_prefix: str | None = None) -> DataFrame:
        v = self.ordered_versions()
        names = (("class_count", "_c"), ("method_count", "_m"), ("field_count", "_f"))
        # what was counted when a version was written is taken; only versions without counts are scanned
        unknown = [r["version_id"] for r in self.versions.where(" or ".join(f"{n} is null" for n, _ in names)).select("version_id").collect()]
        of = lambda t: t.where(F.col("version_id").isin(unknown)).groupBy("version_id")
        if unknown:
            counts = of(self.classes).agg(F.count("*").alias("_c"))
            m = of(self.members).agg(F.count_if(F.col("kind") == "method").alias("_m"), F.count_if(F.col("kind") == "field").alias("_f"))
            v = v.join(counts, "version_id", "left").join(m, "version_id", "left")
            for stored_count, found in names:
                v = v.withColumn(stored_count, F.coalesce(stored_count, found, F.lit(0)))
        return self._filtered(v.drop("_c", "_m", "_f"), include_variants, releases_only, release_type, id_prefix).orderBy("rank")

    @staticmethod
    def _filtered(v: DataFrame, include_variants: bool, releases_only: bool, release_type: str | None = None, id_prefix: str | None = None) -> DataFrame:
        if not include_variants:
            v = v.where("variant_of is null")
        if releases_only:
            v = v.where("release_type = 'release'")
        if release_type:
            v = v.where(F.col("release_type") == release_type)
        return v.where(F.col("version_id").startswith(id_prefix)) if id_prefix else v

    def latest_release(self) -> str | None:
        v = self.ordered_versions().where("variant_of is null").orderBy((F.col("release_type") == "release").desc_nulls_last(), F.desc("rank")).first()
        return v and v["version_id"]

    def version_range(self, start: str | None = None, end: str | None = None, include_variants: bool = True, releases_only: bool = False) -> DataFrame:
        """Slice between two bounds in either order; filters narrow the content, not the bounds."""
        v = self.ordered_versions()
        ranks = {r["version_id"]: r["rank"] for r in v.where(F.col("version_id").isin([x for x in (start, end) if x])).collect()}
        for x in (start, end):
            if x and x not in ranks:
                raise QueryError(f"unknown version {x!r}", 404)
        lo, hi = ranks.get(start), ranks.get(end)
        if lo is not None and hi is not None and lo > hi:
            lo, hi = hi, lo
        if lo is not None:
            v = v.where(F.col("rank") >= lo)
        if hi is not None:
            v = v.where(F.col("rank") <= hi)
        return self._filtered(v, include_variants, releases_only)

    def _some_versions(self, start: str | None, end: str | None, releases_only: bool = False) -> DataFrame:
        """A range that a request may read version by version: (version_id, rank)."""
        v = self.version_range(start, end, releases_only=releases_only).select("version_id", "rank")
        n = v.count()
        if n > CAPS["versions"]:
            raise QueryError(f"the range holds {n} versions, at most {CAPS['versions']} can be asked for")
        return v

    def version(self, version_id: str):
        v = self.versions.where(F.col("version_id") == version_id).first()
        if v is None:
            raise QueryError(f"unknown version {version_id!r}", 404)
        return v

    def _classes(self, version_id: str) -> DataFrame:
        return self.classes.where(F.col("version_id") == version_id)

    def _members(self, version_id: str, kind: str | None = None) -> DataFrame:
        m = self.members.where(F.col("version_id") == version_id)
        return m.where(F.col("kind") == kind) if kind else m

    def list_classes(self, version_id: str) -> DataFrame:
        self.version(version_id)
        return self._classes(version_id).select("obf_name", "intermediary_name", "yarn_name", "mojmap_name", "package_path", "simple_name", "presence").orderBy("yarn_name", "mojmap_name")

    def unknown_versions(self, wanted: list[str]) -> DataFrame:
        """The wanted versions that there are none of."""
        return self.spark.createDataFrame([(v,) for v in wanted], "version_id string").join(self.versions.select("version_id"), "version_id", "left_anti")

    def without_references(self, wanted: list[str], ns: str) -> DataFrame:
        """The wanted versions whose references are not built for a namespace."""
        built = self.refs.where((F.col("ns") == ns) & F.col("version_id").isin(wanted)).select("version_id")
        return self.spark.createDataFrame([(v,) for v in wanted], "version_id string").join(built, "version_id", "left_anti")

    def first_unavailable(self, version_id: str, namespaces: list[str]) -> str | None:
        """The first namespace that a version has no names in; obfuscated names are always there."""
        v = self.version(version_id)
        has = {"yarn_name": v["has_yarn"], "mojmap_name": v["has_mojmap"], "intermediary_name": v["has_intermediary"], "obf_name": True}
        return next((n for n in namespaces if not has[column_of(n)]), None)

    def candidates(self, version_id: str, class_name: str, ns: str, limit: int = 10) -> DataFrame:
        """(name): classes with the simple name of one that isn't there."""
        name = column_of(ns)
        hit = F.substring_index(F.substring_index(name, "/", -1), "$", -1) == re.split(r"[/$]", class_name)[-1]
        return self._classes(version_id).where(hit).select(F.col(name).alias("name")).orderBy("name").limit(limit)

    # differences

    def identity(self, old: str, new: str) -> str | None:
        """The column that names the same entity in both versions."""
        a, b = self.version(old), self.version(new)
        if a["has_intermediary"] and b["has_intermediary"]:
            return "intermediary_name"
        return "mojmap_name" if a["has_mojmap"] and b["has_mojmap"] else None

    def diff(self, old: str, new: str, ns: str = "yarn", kind: str = "all", package: str | None = None, change: str = "all", limit: int = 200, include_synthetic: bool = True) -> DataFrame:
        """(bucket, kind, key, old_name, new_name, truncated), each bucket cut to ``limit``."""
        whole = self.diff_all(old, new, ns, kind, package, include_synthetic)
        if change != "all":
            whole = whole.where(F.col("bucket") == change)
        rank = F.element_at(F.create_map(*[F.lit(x) for x in ("class", 0, "method", 1, "field", 2)]), F.col("kind"))
        return D.cut_buckets(whole.withColumn("kind_rank", rank), ["kind_rank", "new_name", "old_name", "key"], limit).drop("kind_rank", "pos")

    def diff_all(self, old: str, new: str, ns: str = "yarn", kind: str = "all", package: str | None = None, include_synthetic: bool = True) -> DataFrame:
        name, key = column_of(ns, "yarn"), self.identity(old, new)
        out = self.spark.createDataFrame([], "bucket string, key string, old_name string, new_name string, owner string, kind string")
        if key is None:
            return out
        if kind in ("all", "class"):
            side = lambda v: self._classes(v).select(F.col(key).alias("key"), F.col(name).alias("name"))
            d = D.diff_by_key(side(old), side(new), ["key"], "name").withColumn("owner", F.coalesce("new_name", "old_name")).withColumn("kind", F.lit("class"))
            out = out.unionByName(d.where("bucket <> 'renamed'") if key == name else d)
        for k in ("method", "field"):
            if kind in ("all", k):
                d = D.diff_by_key(self._keyed(old, k, key, name), self._keyed(new, k, key, name), ["key"], "name", both_named=True).withColumn("kind", F.lit(k))
                d = d.join(self._owners(old, new, k, key, name), "key", "left")
                out = out.unionByName(d.where("bucket <> 'renamed'") if key == name else d)
        if package:
            out = out.where(D.in_package(F.col("owner"), package))
        if not include_synthetic:
            out = out.where(D.not_synthetic(F.col("new_name")) & D.not_synthetic(F.col("old_name")))
        return out

    def _keyed(self, version_id: str, kind: str, key: str, name: str) -> DataFrame:
        """Members with owner key, member key and descriptor as one key; null if a part is null."""
        own = self._classes(version_id).select("class_id", F.col(key).alias("owner_key"), F.col(name).alias("owner_name"))
        m = self._members(version_id, kind).join(own, "class_id")
        part = F.col("mojmap_name") if key == "mojmap_name" else F.coalesce("intermediary_name", "mojmap_name", "obf_name")
        whole = F.concat("owner_key", F.lit("#"), part, F.coalesce("stable_desc", "obf_desc"))
        return m.select(whole.alias("key"), F.col("owner_name").alias("owner"), F.col(name).alias("name"))

    def _owners(self, old: str, new: str, kind: str, key: str, name: str) -> DataFrame:
        """Owner name of each member key, the new version's first."""
        both = self._keyed(new, kind, key, name).withColumn("_p", F.lit(0)).union(self._keyed(old, kind, key, name).withColumn("_p", F.lit(1)))
        return both.where("key is not null").groupBy("key").agg(F.min_by("owner", "_p").alias("owner"))

    def diff_summary(self, old: str, new: str, ns: str = "yarn") -> DataFrame:
        return D.summary(self.diff_all(old, new, ns))

    def diff_files(self, old: str, new: str, mapping: str, prefix: str = "") -> DataFrame:
        f = self.source_files.where((F.col("mapping_type") == mapping) & F.col("relative_path").startswith(prefix))
        side = lambda v: f.where(F.col("version_id") == v)
        return D.changed_files(side(old), side(new), "relative_path", "content_hash").select("path", "change").orderBy("path")

    def diff_class(self, old: str, new: str, class_name: str, ns: str = "yarn", limit: int = 200) -> DataFrame:
        """Members of one class on both sides, followed over a rename of the class: (bucket, kind, key, old_name, new_name, truncated).

        Keys are ``name#descriptor`` by the first naming there is; of duplicates the
        last stays. A class on one side only pairs with the one class of its identity.
        """
        return D.cut_buckets(self._diff_class(old, new, class_name, ns), ["kind", "key"], limit).drop("pos")

    def diff_classes(self, old: str, new: str, class_names: list[str], ns: str = "yarn", limit: int = 200) -> DataFrame:
        """``diff_class`` of several classes: each is cut, then their buckets together; truncated, for all rows alike, if any cut took a row."""
        one = [D.cut_buckets(self._diff_class(old, new, c, ns), ["kind", "key"], limit).withColumn("class_pos", F.lit(i)) for i, c in enumerate(capped(class_names, "classes"))]
        both = reduce(DataFrame.unionByName, one)
        cut = D.cut_buckets(both.drop("pos", "truncated"), ["class_pos", "kind", "key"], limit).drop("pos", "class_pos")
        any_cut = both.groupBy("bucket").agg((F.bool_or("truncated") | (F.count("*") > limit)).alias("t")).agg(F.bool_or("t").alias("truncated"))
        return cut.drop("truncated").join(F.broadcast(any_cut))

    def diff_classes_summary(self, old: str, new: str, class_names: list[str], ns: str = "yarn") -> DataFrame:
        """(kind, bucket, n) summed over the classes, before any cut."""
        return D.summary(reduce(DataFrame.unionByName, [self._diff_class(old, new, c, ns) for c in capped(class_names, "classes")]))

    def _diff_class(self, old: str, new: str, class_name: str, ns: str) -> DataFrame:
        name, key = column_of(ns, "yarn"), self.identity(old, new)
        sides = {v: self._classes(v).where(F.col(name) == class_name).limit(1).collect() for v in (old, new)}
        if key and key != name:
            for here, there in ((old, new), (new, old)):
                if sides[here] and not sides[there] and sides[here][0][key] is not None:
                    found = self._classes(there).where(F.col(key) == sides[here][0][key]).limit(2).collect()
                    sides[there] = found if len(found) == 1 else []

        def members(v: str) -> DataFrame:
            m = self._members(v).where(F.col("class_id") == (sides[v][0]["class_id"] if sides[v] else -1))
            k = F.concat("kind", F.lit("#"), F.coalesce("intermediary_name", "mojmap_name", "obf_name"), F.lit("#"), F.coalesce("stable_desc", "obf_desc", F.lit("")))
            return C.first_wins(m.withColumn("key", k).withColumn("_n", -F.col("member_id")), ["key"], ["_n"]).select("key", "kind", F.col(name).alias("name"))

        a, b = members(old), members(new)
        d = D.diff_by_key(a, b, ["key", "kind"], "name")
        own = [(x[0][key] if key else class_name, x[0][name]) if x else (None, None) for x in (sides[old], sides[new])]
        if own[0] != own[1]:
            bucket = "renamed" if all(x[0] for x in own) else "added" if own[1][0] else "removed"
            c = self.spark.createDataFrame([(bucket, str(own[0][0] or own[1][0]), "class", own[0][1], own[1][1])], "bucket string, key string, kind string, old_name string, new_name string")
            d = d.unionByName(c)
        return d

    def diff_patch(self, old: str, new: str, mapping: str, path: str | None = None, function: str | None = None, context: int = 3, ignore_space: bool = False) -> DataFrame:
        """(path, patch) of all changed files, or of one function of them."""
        from verspan.operators.linediff import patch_column, slice_column

        t = self.source_text.where(F.col("mapping_type") == mapping)
        t = t.where(F.col("relative_path").startswith(path)) if path else t
        text = slice_column(F.col("text"), function) if function else F.col("text")
        side = lambda v, c: t.where(F.col("version_id") == v).select(F.col("relative_path").alias("path"), text.alias(c))
        both = side(old, "old").join(side(new, "new"), "path", "full").where(~F.col("old").eqNullSafe(F.col("new")))
        return both.select("path", patch_column(F.col("path"), F.col("old"), F.col("new"), context, ignore_space).alias("patch")).where("patch <> ''").orderBy("path")

    def blame(self, version_id: str, mapping: str, path: str) -> DataFrame:
        """(line_no, line, version_id): the version that brought each line; variants count as their base."""
        from verspan.operators.linediff import blame_lines

        v = self.version_range(None, version_id).select("version_id", "rank", F.coalesce("variant_of", "version_id").alias("base"))
        t = self.source_text.where((F.col("mapping_type") == mapping) & (F.col("relative_path") == path)).join(F.broadcast(v), "version_id")
        return blame_lines(t, "relative_path", "rank", "text").join(v.select(F.col("rank").cast("long").alias("version"), F.col("base").alias("version_id")), "version").select("line_no", "line", "version_id").orderBy("line_no")

    def body_hash(self, ns: str, queries: list[str], start: str | None = None, end: str | None = None, normalize: str = "none") -> DataFrame:
        """Spans of equal body hashes of ``owner:name[:descriptor]``; without a descriptor all overloads count.

        normalize="intermediary": classes that a body names are hashed by their intermediary names, so that
        a renamed or moved class changes no hash; the names of members stay.
        """
        if normalize not in ("none", "intermediary"):
            raise QueryError(f"unknown normalisation {normalize!r}")
        q = self.spark.createDataFrame([(x, *(x.split(":", 2) + [None, None])[:3]) for x in capped(queries, "post queries")], "query string, owner string, member string, d string")
        b = self.bodies.where(F.col("ns") == ns).join(F.broadcast(q), ["owner", "member"]).where("d is null or d = descriptor")
        if normalize == "intermediary":
            name = "yarn_name" if column_of(ns) == "yarn_name" else "mojmap_name"
            used = b.select("version_id", F.explode(types_in(F.col("body"))).alias(name)).distinct()  # only what the bodies name
            known = self.classes.join(used, ["version_id", name]).where("intermediary_name is not null").groupBy("version_id", name).agg(F.max_by("intermediary_name", "class_id").alias("to"))
            maps = known.groupBy("version_id").agg(F.map_from_entries(F.collect_list(F.struct(name, "to"))).alias("names"))
            b = b.join(maps, "version_id", "left").withColumn("body", F.when(F.col("names").isNull(), F.col("body")).otherwise(rename_types(F.col("body"), F.col("names"))))
        h = b.groupBy("query", "version_id").agg(body_hash(F.collect_list(F.struct("descriptor", "body"))).alias("hash"))
        grid = self._some_versions(start, end).join(F.broadcast(q.select("query")))
        ends = [F.min_by("version_id", "rank").alias("from"), F.max_by("version_id", "rank").alias("to")]
        return S.collapse(grid.join(h, ["query", "version_id"], "left"), ["query"], "rank", ["hash"], ends).orderBy("query", "from_v").drop("from_v", "to_v")

    def validate(self, ns: str, owner: str, method: str, descriptor: str | None, at: str | None, start: str, end: str) -> DataFrame:
        """(version_id, status, at_count, closest, moved_to, reason) for an injection point over a range of versions.

        ok: declared (and, with ``at``, calling it); call_moved: declared without the call;
        renamed: another descriptor, here or above; inherited: declared above; else missing.
        One row a version; versions are few, so the moves of calls are looked up one by one.
        """
        v = self._some_versions(start, end)
        i = self.instructions.where((F.col("ns") == ns) & (F.col("owner") == owner))
        hit = F.col("target").eqNullSafe(at) | F.coalesce(F.startswith("target", F.lit(f"{at}:")), F.lit(False)) if at else F.lit(False)
        asked = (F.col("method") == method) & ((F.col("descriptor") == descriptor) if descriptor else F.lit(True))
        calls = i.where(hit).groupBy("version_id").agg(F.count_if(asked).alias("hits"), F.collect_set(F.struct("method", "descriptor")).alias("holders"))
        d = self.decls.where(F.col("ns") == ns).join(F.broadcast(v.select("version_id")), "version_id", "left_semi")
        # supertypes of every version at once, nearest first; a node is a class of a version
        at_version = lambda c: F.concat_ws("\n", "version_id", c)
        edges = d.select(at_version("owner").alias("child"), F.explode("supertypes").alias("s"), "version_id").where("s <> 'java/lang/Object'").select("child", at_version("s").alias("parent"))
        up = G.closure(edges, d.where(F.col("owner") == owner).select(at_version("owner").alias("root")).distinct(), "child", "parent")
        declared = d.select("version_id", "owner", F.posexplode("members").alias("p", "m")).where((F.col("m.name") == method) & F.startswith("m.descriptor", F.lit("(")))
        exact = (F.col("m.descriptor") == descriptor) if descriptor else F.lit(True)
        near = up.join(declared.select(at_version("owner").alias("node"), "version_id", F.concat_ws(":", "owner", "m.name", "m.descriptor").alias("key"), exact.alias("exact"), "p"), "node")
        order = F.struct("depth", "node", "p")
        best = lambda when: F.min_by("key", F.when(when, order))
        here = F.col("depth") == 0
        near = near.groupBy("version_id").agg(F.bool_or(here & F.col("exact")).alias("has"), best(here).alias("named"), best(~here & F.col("exact")).alias("above"), best(~here).alias("above_named"))
        known = d.where(F.col("owner") == owner).select("version_id", F.lit(True).alias("known")).distinct()
        all_ = v.join(calls, "version_id", "left").join(near, "version_id", "left").join(known, "version_id", "left")
        hits = F.coalesce("hits", F.lit(0))
        status = F.when(F.col("known").isNull(), "missing").when(F.col("has") & (F.lit(at is None) | (hits > 0)), "ok").when(F.col("has"), "call_moved").when(F.col("named").isNotNull(), "renamed").when(F.col("above").isNotNull(), "inherited").when(F.col("above_named").isNotNull(), "renamed").otherwise("missing")
        closest = F.when(status == "inherited", F.col("above")).when(status == "renamed", F.coalesce("named", "above_named"))
        moved = F.when((status == "call_moved") | (status == "missing") & F.col("known"), F.when(F.size("holders") == 1, F.concat(F.lit(f"{owner}#"), F.col("holders")[0]["method"])))
        reason = F.when(F.col("known").isNull(), "unknown-owner").when(status == "missing", "unknown-target")
        out = all_.select("version_id", "rank", status.alias("status"), F.when((status == "ok") & F.lit(at is not None), hits).alias("at_count"), closest.alias("closest"), moved.alias("moved_to"), reason.alias("reason"))
        return self._moves_located(out, ns, owner, method, at).orderBy("rank").drop("rank")

    def _moves_located(self, verdicts: DataFrame, ns: str, owner: str, method: str, at: str | None) -> DataFrame:
        """Where a call left the class: the site that pairs with the hooked one since the last version that was ok."""
        rows, last, built, asked = [r.asDict() for r in verdicts.orderBy("rank").collect()], None, None, {}
        for r in rows:
            if r["status"] == "ok":
                last = r["version_id"]
            if r["status"] != "call_moved" or r["moved_to"]:
                continue
            if built is None:
                built = set() if self.refs is None else {x["version_id"] for x in self.refs.where(F.col("ns") == ns).select("version_id").distinct().collect()}
            if last is None:
                r["reason"] = "no-baseline"
            elif at.count(":") == 1:
                r["reason"] = "at-without-descriptor"
            elif not {last, r["version_id"]} <= built:
                r["reason"] = "no-named-jar"
            else:
                asked[r["version_id"]] = (last, r["version_id"])
        if asked:  # all pairs of versions at once
            site = ["pair", "ref_owner", "ref_member"]
            moved = self._moves(self._changed_sites(list(asked.values()), at, ns)).where((F.concat_ws("#", "old.ref_owner", "old.ref_member") == f"{owner}#{method}"))
            found = {list(asked)[r["pair"]]: r["to"] for r in moved.select(F.col(f"old.{site[0]}").alias("pair"), F.concat_ws("#", "new.ref_owner", "new.ref_member").alias("to")).collect()}
            for r in rows:
                if r["version_id"] in asked:
                    r["moved_to"], r["reason"] = found.get(r["version_id"]), None if r["version_id"] in found else "unpaired"
        return self.spark.createDataFrame(rows, verdicts.schema)

    def _changed_sites(self, pairs: list[tuple[str, str]], query: str, ns: str) -> DataFrame:
        """(side, pair, ref_owner, ref_member, targets) of the sites that refer to a class or member in one version of a pair only."""
        versions = sorted({v for p in pairs for v in p})
        places = self._normalised(versions, ns, query)
        owners, member = self.spark.createDataFrame(list(places.items()), "version_id string, owner string"), query.partition(":")[2]
        r = self._refs(versions, ns, sorted(set(places.values()))).where("ref_member is not null").where(F.col("member") == member if member else "member <> ''")
        sides = self.spark.createDataFrame([(i, side, v) for i, p in enumerate(pairs) for side, v in zip(("old", "new"), p)], "pair int, side string, version_id string")
        edges = r.join(F.broadcast(owners), ["version_id", "owner"], "left_semi").join(F.broadcast(sides), "version_id")  # a row for each version asked for
        return stored(R.one_sided(edges, ["pair", "ref_owner", "ref_member"], "member"), "sites")

    @staticmethod
    def _moves(changed: DataFrame) -> DataFrame:
        return R.pair_moves(changed, ["pair", "ref_owner", "ref_member"], [["pair", "targets", "ref_member"], ["pair", "targets", "ref_owner"], ["pair", "targets"]])

    def _normalised(self, versions: list[str], ns: str, target: str) -> dict[str, str]:
        """The class whose references a target's are held under, for each version: its owner, or the nearest supertype that declares the member."""
        owner, _, member = target.partition(":")
        found = dict.fromkeys(versions, owner)
        if member and self.decls is not None:
            d = self._side(self.decl_index, self.decls, versions, ns, None)
            at_version = lambda c: F.concat_ws("\n", "version_id", c)
            edges = d.select(at_version("owner").alias("child"), "version_id", F.explode("supertypes").alias("s")).select("child", at_version("s").alias("parent"))
            up = G.closure(edges, self.spark.createDataFrame([(f"{v}\n{owner}",) for v in versions], "root string"), "child", "parent")
            has = F.exists("members", lambda m: F.concat_ws(":", m["name"], m["descriptor"]) == member)
            hit = up.join(d.where(has).select(at_version("owner").alias("node"), "version_id", "owner"), "node")
            found |= {r["version_id"]: r["o"] for r in hit.groupBy("version_id").agg(F.min_by("owner", F.struct("depth", "node")).alias("o")).collect()}  # a row for each version
        return found

    def validate_spans(self, ns: str, owner: str, method: str, descriptor: str | None, at: str | None, start: str, end: str, collapse: str = "verdict") -> DataFrame:
        """Runs of versions with an equal verdict, or an equal status; by status a run of several has no count."""
        order = self.version_range(start, end).select("version_id", "rank")
        v = self.validate(ns, owner, method, descriptor, at, start, end).join(order, "version_id").withColumn("q", F.lit(0))
        rest = ["at_count", "closest", "moved_to", "reason"]
        ends = [F.min_by("version_id", "rank").alias("from"), F.max_by("version_id", "rank").alias("to")]
        if collapse == "verdict":
            out = S.collapse(v, ["q"], "rank", ["status", *rest], ends)
        else:
            out = S.collapse(v, ["q"], "rank", ["status"], ends + [F.min_by(c, "rank").alias(c) for c in rest]).withColumn("at_count", F.when(F.col("versions") == 1, F.col("at_count")))
        return out.orderBy("from_v").select("from", "to", "versions", "status", *rest)

    # history

    def history(self, query: str, ns: str = "mojmap", start: str | None = None, end: str | None = None, releases_only: bool = False, include_variants: bool = True) -> DataFrame:
        """Spans of equal state of a class, followed over renames by its identity and by unique moves.

        A member ``owner:name[:descriptor]`` has the spans of ``member_history``.
        """
        if query.partition(":")[2]:
            return self.member_history(query, ns, start, end, releases_only, include_variants)
        name = column_of(ns, "mojmap")
        one = self._owner_rows(name, query.partition(":")[0])
        wanted = self.version_range(start, end, include_variants, releases_only).select("version_id", "rank")
        state = ["present", "intermediary_name", "yarn_name", "mojmap_name"]
        if one is None:
            line = wanted.select("version_id", "rank", F.lit(False).alias("present"), *[F.lit(None).cast("string").alias(s) for s in state[1:]])
        else:
            line = wanted.join(one.select("version_id", F.lit(True).alias("present"), "intermediary_name", real_name(F.col("yarn_name")).alias("yarn_name"), "mojmap_name"), "version_id", "left").withColumn("present", F.coalesce("present", F.lit(False)))
        line = line.withColumn("query", F.lit(query))
        ends = [F.min_by("version_id", "rank").alias("from"), F.max_by("version_id", "rank").alias("to")]
        return S.collapse(line, ["query"], "rank", state, ends).orderBy("from_v").drop("from_v", "to_v")

    def member_history(self, query: str, ns: str = "mojmap", start: str | None = None, end: str | None = None, releases_only: bool = False, include_variants: bool = True) -> DataFrame:
        """(query, type, present, owner, members, reason, declared_in, from, to, versions) of ``owner:name[:descriptor]``.

        All overloads come together, a descriptor is not matched on; owner and member are
        followed over renames, methods come before fields. A member that only a supertype
        declares, found where the owner is newest, is not present and ``inherited``; one
        that nothing declares is of type unknown.
        """
        name = column_of(ns, "mojmap")
        owner, member = query.split(":")[:2]
        own = self._owner_rows(name, owner)
        wanted = self.version_range(start, end, include_variants, releases_only).select("version_id", "rank")
        kind, rows = self._member_rows(own, member, name)
        above = None
        if own is not None and rows is None:
            above = self._declaring(own, member, name, wanted)
            kind, rows = self._member_rows(above, member, name)
        line = wanted if own is None else wanted.join(own.select("version_id", F.col(name).alias("owner")), "version_id", "left")
        if own is None:
            line = line.withColumn("owner", F.lit(None).cast("string"))
        if rows is None:
            entries = "array<struct<intermediary:string,intermediary_descriptor:string,mojmap_descriptor:string,yarn:string,mojmap:string,signature:string>>"
            line = line.withColumn("members", F.array().cast(entries)).withColumn("declared_in", F.lit(None).cast("string"))
        else:
            entry = F.struct(F.col("intermediary_name").alias("intermediary"), F.col("intermediary_desc").alias("intermediary_descriptor"), "mojmap_descriptor", real_name(F.col("yarn_name")).alias("yarn"), F.col("mojmap_name").alias("mojmap"), F.coalesce("stable_desc", "obf_desc").alias("signature"))
            at = rows.groupBy("version_id").agg(F.sort_array(F.collect_list(entry)).alias("members"))
            line = line.join(at, "version_id", "left").withColumn("members", F.coalesce("members", F.array()))
            there = F.lit(None).cast("string").alias("declared_in") if above is None else F.col(name).alias("declared_in")
            line = line.join((own if above is None else above).select("version_id", there), "version_id", "left")
        some = F.size("members") > 0
        line = line.withColumn("declared_in", F.when(some, F.col("declared_in"))).withColumn("present", some & F.lit(above is None)).withColumn("reason", F.when(some & F.lit(above is not None), "inherited"))
        line = line.withColumn("query", F.lit(query)).withColumn("type", F.lit(kind))
        ends = [F.min_by("version_id", "rank").alias("from"), F.max_by("version_id", "rank").alias("to")]
        return S.collapse(line, ["query", "type"], "rank", ["present", "owner", "members", "reason", "declared_in"], ends).orderBy("from_v").drop("from_v", "to_v")

    def _owner_rows(self, name: str, owner: str) -> DataFrame | None:
        """One row of a class for each version that has it; inner classes may be spelt with slashes or dots."""
        ranked = self.ordered_versions().select("version_id", "rank", "has_intermediary")
        c = self.classes.join(F.broadcast(ranked), "version_id")
        spelt = [owner if "/" in owner else owner.replace(".", "/")]
        while "/" in spelt[-1]:
            head, _, tail = spelt[-1].rpartition("/")
            spelt.append(f"{head}${tail}")
        there = {r[0] for r in c.where(F.col(name).isin(spelt)).select(name).distinct().collect()}  # some of the spellings
        q = next((x for x in spelt if x in there), None)
        if q is None:
            return None
        return C.first_wins(self._anchored(c, c.where(F.col(name) == q), name, q).withColumn("_n", -F.col("class_id")), ["version_id"], ["_n"])

    def _member_rows(self, own: DataFrame | None, member: str, name: str) -> tuple[str, DataFrame | None]:
        """(kind, rows) of a member in each version of its owner, by name or by the identity of its newest match."""
        if own is None:
            return "unknown", None
        m = self.members.join(own.select("version_id", "class_id", "rank"), ["version_id", "class_id"])
        im = F.max_by("intermediary_name", F.when(F.col("intermediary_name").isNotNull(), F.col("rank"))).alias("im")
        found = {r["kind"]: r["im"] for r in m.where(F.col(name) == member).groupBy("kind").agg(im).collect()}  # two kinds
        for kind in ("method", "field"):
            if kind in found:
                same = F.col(name) == member
                k = m.where(F.col("kind") == kind)
                return kind, self._mojmap_descriptors(k.where(same if found[kind] is None else same | (F.col("intermediary_name") == found[kind])))
        return "unknown", None

    def _mojmap_descriptors(self, rows: DataFrame) -> DataFrame:
        """Add ``mojmap_descriptor``; a class that has no such name keeps its own."""
        types = rows.select("version_id", "member_id", F.explode(F.array_distinct(F.regexp_extract_all("obf_desc", F.lit("L([^;]+);"), 1))).alias("obf_name"))
        named = types.join(self.classes.where("mojmap_name is not null").select("version_id", "obf_name", "mojmap_name"), ["version_id", "obf_name"]).groupBy("version_id", "member_id", "obf_name").agg(F.min("mojmap_name").alias("to"))
        maps = named.groupBy("version_id", "member_id").agg(F.map_from_entries(F.collect_list(F.struct("obf_name", "to"))).alias("_names"))
        names = F.coalesce("_names", F.create_map().cast("map<string,string>"))
        return rows.join(maps, ["version_id", "member_id"], "left").withColumn("mojmap_descriptor", map_types(F.col("obf_desc"), names)).drop("_names")

    def _declaring(self, own: DataFrame, member: str, name: str, wanted: DataFrame) -> DataFrame | None:
        """Rows of the nearest supertype that declares a member, found at the newest wanted version of the class."""
        newest = own.join(wanted.select("version_id"), "version_id", "left_semi").orderBy(F.desc("rank")).first()
        if newest is None or self.decls is None:
            return None
        d = self.decls.where((F.col("version_id") == newest["version_id"]) & (F.col("ns") == ("yarn" if name == "yarn_name" else "mojmap")))
        up = G.closure(d.select("owner", F.explode("supertypes").alias("parent")), self.spark.createDataFrame([(newest[name],)], "root string"), "owner", "parent").where("depth > 0")
        hit = up.join(d.where(F.exists("members", lambda m: m["name"] == member)).select(F.col("owner").alias("node")), "node").orderBy("depth", "node").first()
        return hit and self._owner_rows(name, hit["node"])

    def _anchored(self, c: DataFrame, by_name: DataFrame, name: str, q: str) -> DataFrame:
        a = by_name.agg(F.max_by("intermediary_name", F.when(F.col("intermediary_name").isNotNull(), F.col("rank"))).alias("im"), F.min("rank").alias("oldest")).first()
        im = a["im"] or self._neighbour(c, name, q, a["oldest"])
        rows = by_name if im is None else c.where((F.col(name) == q) | (F.col("intermediary_name") == im))
        simple = re.split(r"[/$]", q)[-1]
        ours = F.col("intermediary_name").isNull() if im is None else F.col("intermediary_name").isNull() | (F.col("intermediary_name") == im)
        moved = c.join(rows.select("version_id").distinct(), "version_id", "left_anti").where((F.col("simple_name") == simple) & F.substring_index(F.substring_index(name, "/", -1), "$", -1).eqNullSafe(simple) & ours)
        only = moved.join(moved.groupBy("version_id").count().where("count = 1").select("version_id"), "version_id", "left_semi")
        beside = c.join(rows.select("version_id", F.col(name).alias("_ours")), "version_id").where(F.col(name) != F.col("_ours")).select(name).distinct()
        return rows.unionByName(only.join(beside, name, "left_anti").select(*rows.columns))

    @staticmethod
    def _neighbour(c: DataFrame, name: str, q: str, oldest: int) -> str | None:
        """Identity of the one class with this simple name in the nearest earlier version that has identities."""
        simple = re.split(r"[/$]", q)[-1]
        before = c.where((F.col("rank") < oldest) & F.col("has_intermediary")).agg(F.max("rank")).first()[0]
        found = [] if before is None else c.where((F.col("rank") == before) & (F.substring_index(F.substring_index(name, "/", -1), "$", -1) == simple)).limit(2).collect()
        if len(found) != 1 or not c.where((F.col("rank") == oldest) & (F.col(name) == found[0][name]) & (F.col(name) != q)).isEmpty():
            return None
        return found[0]["intermediary_name"]

    # search

    def build_search_index(self, path: str, versions: list[str] | None = None, force: bool = False) -> list[str]:
        """Indexes the names of the versions that have no index below ``path`` yet and searches there from now on; the versions built.

        The elements are stored first: the index is built from them and a search reads their names there, so that the tables are joined once.
        """
        self.index = SearchIndex(self.spark, path, [*SEARCHED, "simple_name"], "struct<kind_rank: int, id: bigint>")
        self.elements = PartStore(self.spark, f"{path.rstrip('/')}/elements", ELEMENTS, "version_id", order=["kind_rank", "id"])
        wanted = versions or [r["version_id"] for r in self.versions.select("version_id").collect()]
        todo = self.index.store.missing(wanted, force)
        fresh = [v for v in dict.fromkeys(wanted) if v in {*todo, *self.elements.missing(wanted)}]
        self.elements.write(self._elements_of(fresh), fresh, lie=len(fresh) == 1)
        rows = self.elements.read(todo).select(F.col("version_id").alias("version"), F.struct("kind_rank", "id").alias("row"), *SEARCHED, "simple_name")
        return self.index.build(rows, todo, force=True)

    def _elements_of(self, versions: list[str]) -> DataFrame:
        """Classes, methods and fields of versions with qualified names in all namespaces."""
        names = SEARCHED
        c = self.classes.where(F.col("version_id").isin(versions))
        one = c.select("version_id", F.lit(0).alias("kind_rank"), F.lit("class").alias("kind"), F.col("class_id").alias("id"), F.lit(None).cast("bigint").alias("owner_id"), "simple_name", *names)
        own = c.select("version_id", "class_id", *[F.col(n).alias(f"o_{n}") for n in names])
        m = self.members.where(F.col("version_id").isin(versions)).join(own, ["version_id", "class_id"])
        two = m.select("version_id", F.when(F.col("kind") == "method", 1).otherwise(2).alias("kind_rank"), "kind", F.col("member_id").alias("id"), F.col("class_id").alias("owner_id"), "simple_name", *[C.qualified(F.col(f"o_{n}"), F.col(n)).alias(n) for n in names])
        return one.unionByName(two)

    def _elements(self, version_id: str) -> DataFrame:
        rows = self.elements.read([version_id]) if self._indexed(version_id) else self._elements_of([version_id])
        return rows.drop("version_id")

    def _ranked(self, version_id: str, whole: DataFrame, words: list[str], cols: list[str], prefix: bool = True) -> DataFrame | None:
        """(row, score) of a version's elements that hold all words, from the index where the version has one; None if no word has a token."""
        if not words or not all(re.search(r"[^\W_]", w) for w in words):
            return None
        phrases = [(w, prefix and i == len(words) - 1) for i, w in enumerate(words)]
        if self._indexed(version_id):
            return self.index.bm25(version_id, phrases, [*cols, "simple_name"]).select("row", "score")
        return X.bm25(whole.withColumn("row", F.struct("kind_rank", "id")).withColumn("text", F.concat_ws(" ", *cols, "simple_name")), "row", "text", phrases)

    def _indexed(self, version_id: str) -> bool:
        return self.index is not None and version_id in self.index.versions()

    def _or_else(self, version_id: str, primary: DataFrame, fallback: DataFrame) -> DataFrame:
        """The fallback if nothing is found: by a look at the index, or within one plan that scans anyway."""
        if self._indexed(version_id):
            return fallback if primary.isEmpty() else primary
        return X.with_fallback(primary, fallback)

    def search(self, query: str, version_id: str | None = None, kind: str = "all", ns: str = "all", limit: int = 20, offset: int = 0, exact: bool = False, include_synthetic: bool = False) -> DataFrame:
        """Ranked page of names: kind, then BM25; a substring search where no token matches."""
        version_id = version_id or self.latest_release()
        self.version(version_id)
        e = whole = self._elements(version_id)
        if kind != "all":
            e = e.where(F.col("kind") == kind)
        cols = SEARCHED if ns == "all" else [column_of(ns)]
        if not include_synthetic:
            for n in cols:
                e = e.where(D.not_synthetic(F.col(n)))
        split = None if exact else split_owner_member(query)
        keyed = e.withColumn("row", F.struct("kind_rank", "id"))
        if split:
            owner, member = split
            keyed = keyed.join(self._owner_candidates(version_id, whole, owner, cols), "owner_id", "left_semi")
            words = [member]
        else:
            words = [query] if exact else query.replace("/", " ").split()
        # ranked over all of the version's names, whatever is asked to be seen of them
        hits = self._ranked(version_id, whole, words, cols, prefix=not exact)
        kind_order = F.when(F.lit(bool(split)) & (F.col("kind_rank") == 0), 3).otherwise(F.col("kind_rank"))
        order = [kind_order, F.desc(X.squash(F.col("score"))), "id"]
        found = best = None
        if hits is not None and self._indexed(version_id):  # ranked once, by rows without names; names are added to the best of them
            best = stored(X.page(keyed.select("row", "kind_rank", "id").join(hits, "row"), order, limit + offset), "search-page")
            found = keyed.join(F.broadcast(best.select("row", "score").dropDuplicates(["row"])), "row")
        elif hits is not None:
            found = keyed.join(hits, "row")
        if not exact:
            like = keyed.where(F.concat_ws("\n", *cols).ilike(f"%{words[-1] if split else query}%")).withColumn("score", F.lit(0.0))
            if best is not None:
                found = like if best.isEmpty() else found
            else:
                found = like if found is None else X.with_fallback(found.select(*like.columns), like)
        elif found is None:
            found = keyed.limit(0).withColumn("score", F.lit(0.0))
        return X.page(found.withColumn("score", X.squash(F.col("score"))), [kind_order, F.desc("score"), "id"], limit, offset).select("kind", "id", "owner_id", "yarn_name", "mojmap_name", "intermediary_name", "obf_name", "score")

    def _owner_candidates(self, version_id: str, whole: DataFrame, owner: str, cols: list[str], most: int = 200) -> DataFrame:
        """(owner_id) of the best classes for the owner's part of a query, with the supertypes that they inherit members of."""
        c = whole.where("kind = 'class'")
        hits = self._ranked(version_id, whole, owner.replace("/", " ").split(), cols)
        like = c.where(F.concat_ws("\n", *cols).ilike(f"%{owner}%")).select("id", F.lit(0.0).alias("score"))
        best = like if hits is None else self._or_else(version_id, c.join(hits.where("row.kind_rank = 0").select(F.col("row.id").alias("id"), "score"), "id").select("id", "score"), like)
        best = X.page(best, [F.desc("score"), "id"], most).select("id")
        out = best
        for ns in ("yarn", "mojmap") if self.decls is not None else ():
            name = column_of(ns)
            if name in cols:
                d = self._decls(version_id, ns).select("owner", F.explode("supertypes").alias("parent"))
                up = G.closure(d, c.join(best, "id", "left_semi").where(F.col(name).isNotNull()).select(F.col(name).alias("root")), "owner", "parent")
                out = out.union(c.join(up.select(F.col("node").alias(name)).distinct(), name, "left_semi").select("id"))
        return out.distinct().select(F.col("id").alias("owner_id"))

    # lookups

    def translate(self, version_id: str, keys: DataFrame, source: str, target: str) -> DataFrame:
        """(key, result): class or member keys ``owner[:name[:descriptor]]`` in another namespace; null if ambiguous or unknown."""
        a, b = column_of(source), column_of(target)
        c = self._classes(version_id)
        parts = F.split("key", ":", 3)
        k = capped_rows(keys).select(F.col(keys.columns[0]).alias("key")).distinct().select("key", F.get(parts, F.lit(0)).alias("owner"), F.get(parts, F.lit(1)).alias("name"), F.get(parts, F.lit(2)).alias("d"))

        def names(descriptors: DataFrame, x: str, y: str, out: str) -> DataFrame:
            """One row, the names of the classes that a request's descriptors name; a name that two classes share translates to nothing."""
            used = descriptors.select(F.explode(F.array_distinct(F.regexp_extract_all("d", F.lit("L([^;]+);"), 1))).alias(x)).distinct()
            pairs = C.unique_or_null(c.where(F.col(x).isNotNull() & F.col(y).isNotNull()).join(used, x), [x], y, "to").where("to is not null")
            return pairs.agg(F.map_from_entries(F.collect_list(F.struct(F.col(x), F.col("to")))).alias(out))

        k = k.join(F.broadcast(names(k, a, "obf_name", "fwd"))).withColumn("od", map_types(F.col("d"), F.col("fwd")))
        owners = C.unique_or_null(c.where(F.col(a).isNotNull()).select(F.col(a).alias("owner"), F.struct("class_id", F.col(b).alias("to")).alias("x")), ["owner"], "x", "hit")
        k = k.join(owners, "owner", "left")
        m = self._members(version_id).select("class_id", F.col(a).alias("name"), "obf_desc", F.col(b).alias("m_to"))
        hits = k.where("name is not null and hit is not null").select("key", "name", "od", F.col("hit.class_id").alias("class_id")).join(m, ["class_id", "name"]).where("od is null or od = obf_desc")
        one = C.unique_or_null(hits.select("key", F.struct("m_to", "obf_desc").alias("x")), ["key"], "x", "m")
        one = one.join(F.broadcast(names(one.select(F.col("m.obf_desc").alias("d")), "obf_name", b, "back")))
        desc = F.when(F.col("d").isNotNull(), F.concat(F.lit(":"), map_types(F.col("m.obf_desc"), F.col("back")))).otherwise("")
        result = F.when(F.col("name").isNull(), F.col("hit.to")).otherwise(F.concat(F.col("hit.to"), F.lit(":"), F.col("m.m_to"), desc))
        return k.join(one, "key", "left").select("key", result.alias("result"))

    def compare(self, version_id: str, class_name: str, source: str = "yarn") -> DataFrame:
        """Members of one class with both names and their status, methods first."""
        own = self._classes(version_id).where(F.col(column_of(source)) == class_name).select("class_id")
        y, m = real_name(F.col("yarn_name")), F.col("mojmap_name")
        status = F.when(y.isNull() & m.isNull(), "unmapped").when(y.isNull(), "unmappedYarn").when(m.isNull(), "unmappedMojmap").when(y == m, "same").otherwise("different")
        return self._members(version_id).join(own, "class_id", "left_semi").select("kind", "obf_name", "obf_desc", "yarn_name", "mojmap_name", status.alias("status")).orderBy(F.desc("kind"), "obf_name", "obf_desc")

    def exists(self, version_id: str, ns: str, keys: DataFrame) -> DataFrame:
        """(key, exists, reason, nearest): a miss gets the nearest declaration."""
        d = self._decls(version_id, ns)
        flat = d.select("owner", F.explode("members").alias("m")).select("owner", "m.name", "m.descriptor")
        parts = F.split("key", ":", 3)
        k = capped_rows(keys).select(F.col(keys.columns[0]).alias("key")).distinct().select("key", F.get(parts, F.lit(0)).alias("owner"), F.get(parts, F.lit(1)).alias("name"), F.get(parts, F.lit(2)).alias("descriptor"))
        k = k.join(d.select("owner", F.lit(True).alias("known")), "owner", "left")
        hit = k.join(flat.withColumn("hit", F.lit(True)), ["owner", "name", "descriptor"], "left").select("key", F.coalesce("hit", F.col("name").isNull() & F.col("known"), F.lit(False)).alias("exists"))
        miss = k.join(hit.where("not exists"), "key", "left_semi").where("name is not null and known")
        up = G.closure(d.select("owner", F.explode("supertypes").alias("parent")), miss.select("owner").distinct(), "owner", "parent")
        inherited = miss.join(up.select(F.col("root").alias("owner"), F.col("node").alias("at"), "depth").where("depth > 0"), "owner").join(flat.withColumnRenamed("owner", "at"), ["at", "name", "descriptor"])
        inherited = inherited.select("key", F.lit(0).alias("p"), F.col("depth").cast("long").alias("o"), F.lit("inherited").alias("reason"), F.concat_ws(":", "at", "name", "descriptor").alias("nearest"))
        other = miss.withColumnRenamed("descriptor", "asked").join(flat, ["owner", "name"])
        same = F.col("asked").startswith("(") == F.col("descriptor").startswith("(")
        other = other.select("key", F.when(F.col("asked").isNull(), 1).when(same, 2).otherwise(3).alias("p"), F.lit(0).cast("long").alias("o"), F.when(F.col("asked").isNull(), "candidate").when(same, "descriptor").otherwise("kind").alias("reason"), F.concat_ws(":", "owner", "name", "descriptor").alias("nearest"))
        best = C.first_wins(inherited.unionByName(other), ["key"], ["p", "o", "nearest"]).select("key", "reason", "nearest")
        return hit.join(best, "key", "left")

    def hierarchies(self, version_id: str, ns: str, roots: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
        """Nodes (root, name, simple_name, is_interface, is_abstract) and edges (root, parent, child) above and below each of the roots, all at once.

        Without roots every class is one. Above, java/lang/Object and what the version doesn't declare are left
        out; a root that it doesn't declare has no rows.
        """
        d = self._decls(version_id, ns)
        known = d.select(F.col("owner").alias("parent"))
        e = stored(d.select(F.explode("supertypes").alias("parent"), F.col("owner").alias("child")).join(known, "parent", "left_semi").distinct(), "edges")
        r = d.select(F.col("owner").alias("root")) if roots is None else d.where(F.col("owner").isin(roots)).select(F.col("owner").alias("root"))
        up = G.closure(e.where("parent <> 'java/lang/Object'"), r, "child", "parent").select("root", "node")
        down = G.closure(e, r, "parent", "child").select("root", "node")
        above = up.join(e.where("parent <> 'java/lang/Object'"), F.col("node") == F.col("child")).select("root", "parent", "child")
        below = down.join(e, F.col("node") == F.col("parent")).select("root", "parent", "child")
        flag = lambda bit: (F.coalesce(F.col("access"), F.lit(0)).bitwiseAND(bit) != 0)
        nodes = up.union(down).distinct().join(d.select(F.col("owner").alias("node"), "access"), "node")
        nodes = nodes.select("root", F.col("node").alias("name"), F.substring_index("node", "/", -1).alias("simple_name"), flag(0x200).alias("is_interface"), flag(0x400).alias("is_abstract"))
        return nodes, above.union(below).distinct()

    def hierarchy(self, version_id: str, ns: str, root: str) -> tuple[DataFrame, DataFrame]:
        """Nodes and edges above and below one class, which the version must declare."""
        if self._decls(version_id, ns, [root]).isEmpty():
            raise QueryError(f"unknown class {root!r}", 404)
        nodes, edges = self.hierarchies(version_id, ns, [root])
        return nodes.drop("root").orderBy("name"), edges.drop("root").orderBy("parent", "child")

    def superclass_labels(self, ns: str) -> DataFrame:
        """(version_id, owner, depth, first, last): classes under their superclasses, numbered so that a class's subclasses lie between its ends."""
        d = self.decls.where(F.col("ns") == ns).select("version_id", "owner", F.get("supertypes", F.lit(0)).alias("parent"))
        return G.tree_labels(d, ["version_id"], "owner", "parent")

    def references(self, versions: list[str], targets: list[str], ns: str) -> DataFrame:
        """Referrers of each target in each version, ordered; no row for a target without any."""
        t = self.spark.createDataFrame([(x, *(x.split(":", 1) + [""])[:2]) for x in capped(targets, "body")], "target string, owner string, member string")
        capped([v for v in versions if self.ref_index is None or not self.ref_index.has(v, ns)], "scanned versions")
        r = self._refs(versions, ns, list({x.partition(":")[0] for x in targets}))
        return r.join(F.broadcast(t), ["owner", "member"]).select("version_id", "target", "ref_owner", "ref_member", "ref_descriptor", "ref_kind", "ref_synthetic", "cnt").orderBy("version_id", "target", "ref_owner", "ref_member", "ref_synthetic", "ref_descriptor")

    def normalise_target(self, version_id: str, ns: str, target: str) -> str:
        """The key that references are held under: its owner, or the nearest supertype that declares the member."""
        member = target.partition(":")[2]
        return f"{self._normalised([version_id], ns, target)[version_id]}:{member}" if member else target

    def resolve_targets(self, version_id: str, ns: str, targets: list[str]) -> DataFrame:
        """(target, resolved, candidates): whether a key can match, and the keys of the same name that it would match instead."""
        t = self.spark.createDataFrame([(x, x.partition(":")[0], x.partition(":")[2]) for x in capped(targets, "targets")], "target string, owner string, wanted string")
        r = self._refs([version_id], ns, list({x.partition(":")[0] for x in targets})).select("owner", "member").distinct()
        m = t.join(r, "owner", "left")
        same = F.startswith("member", F.concat(F.substring_index("wanted", ":", 1), F.lit(":")))
        m = m.groupBy("target", "owner", "wanted").agg(F.count("member").alias("n"), F.bool_or(F.col("member") == F.col("wanted")).alias("hit"), F.sort_array(F.collect_set(F.when(same, F.concat_ws(":", "owner", "member")))).alias("c"))
        exact = (F.col("wanted") == "") | F.col("hit")
        resolved = (F.col("n") > 0) & (exact | F.contains("wanted", F.lit(":")) & (F.size("c") == 0))
        return m.select("target", resolved.alias("resolved"), F.when((F.col("n") > 0) & ~exact, F.col("c")).otherwise(F.array().cast("array<string>")).alias("candidates"))

    def diff_references(self, old: str, new: str, query: str, ns: str) -> DataFrame:
        """(change, site, targets, moved_to) of the calling sites ``owner#member`` of a class or member.

        Moves pair a removed with an added site that reach the same targets; both stay
        removed and added as well.
        """
        site = ["ref_owner", "ref_member"]
        changed = self._changed_sites([(old, new)], query, ns)
        removed, added = (changed.where(F.col("side") == x) for x in ("old", "new"))
        name = lambda c="": F.concat_ws("#", f"{c}ref_owner", f"{c}ref_member")
        pairs = self._moves(changed)
        none = F.lit(None).cast("string").alias("moved_to")
        side = lambda d, c: d.select(F.lit(c).alias("change"), name().alias("site"), "targets", none)
        moved = removed.join(pairs.select("old.*", "new"), site).select(F.lit("moved").alias("change"), name().alias("site"), "targets", name("new.").alias("moved_to"))
        return side(added, "added").unionByName(side(removed, "removed")).unionByName(moved).orderBy("change", "site")

    def call_chains(self, version_id: str, ns: str, target: str, depth: int = 3, most: int = 200) -> DataFrame:
        """Chains of callers of ``owner:name:descriptor``, outermost first."""
        if not 1 <= depth <= CAPS["depth"]:
            raise QueryError(f"depth is 1 to {CAPS['depth']}")
        r = self._refs([version_id], ns).where("ref_member is not null")
        e = r.select(F.concat_ws(":", "owner", "member").alias("callee"), F.concat_ws(":", "ref_owner", "ref_member", "ref_descriptor").alias("caller"))
        return G.call_chains(e, self.spark.createDataFrame([(target,)], "target string"), "callee", "caller", depth, most=most)

    # resources

    def ord_of(self, version: str) -> int:
        """The ordinal of a version named by any of its three ids."""
        v = self.resource_versions
        hit = v.where((F.col("source_id") == version) | (F.col("name") == version) | (F.col("version_id") == version)).agg(F.min("ord")).first()[0]
        if hit is None:
            raise QueryError(f"unknown version {version!r}", 404)
        return hit

    def resource_tree(self, ord_: int, prefix: str = "") -> DataFrame:
        return S.directory(S.at_point(self.runs, ord_), prefix).orderBy(F.desc("is_dir"), "name")

    def resource_file(self, path: str, ord_: int) -> DataFrame:
        """(path, blob, kind, size, content_type) of a file as it is at an ordinal; no row if it isn't there."""
        return S.at_point(self.runs.where(F.col("path") == path), ord_).select("path", "blob", "kind", "size", content_type(F.col("path")).alias("content_type"))

    def resource_diff(self, old: int, new: int, prefix: str = "") -> DataFrame:
        return S.interval_diff(self.runs.where(F.col("path").startswith(prefix)), ["path"], "blob", old, new).orderBy("path")

    def search_resources(self, query: str, kind: str = "content", ord_: int | None = None, limit: int = 50) -> DataFrame:
        """The best contents (path, from_ord, to_ord, blob) or translations (path, from_ord, to_ord, key, value), every word as a phrase.

        What isn't alive at ``ord_`` goes before the best are taken.
        """
        words = [(w, False) for w in query.split() if re.search(r"[^\W_]", w)]
        if not words:
            raise QueryError("nothing to search for")
        if kind == "translation":
            t = self.translations.withColumn("row", F.struct("path", "key", "from_ord"))
            hits = self.translation_index.bm25(RESOURCES, words).select("row", "score") if self.translation_index else X.bm25(t.withColumn("text", F.concat_ws(" ", "key", "value")), "row", "text", words)
            alive = t if ord_ is None else S.at_point(t, ord_)
            return X.page(alive.join(hits, "row"), [F.desc("score"), "row"], limit).select("path", "from_ord", "to_ord", "key", "value")
        alive = self.runs if ord_ is None else S.at_point(self.runs, ord_)
        hits = self.content_index.bm25(RESOURCES, words).select("row", "score") if self.content_index else X.bm25(self.contents, "blob", "text", words)
        hits = hits.join(alive.select(F.col("blob").alias("row")), "row", "left_semi")
        best = X.page(hits, [F.desc("score"), "row"], limit)
        return alive.join(F.broadcast(best), alive["blob"] == best["row"]).orderBy(F.desc("score"), "blob", "path", "from_ord").limit(limit).select("path", "from_ord", "to_ord", "blob")

    def build_resource_index(self, path: str, force: bool = False) -> None:
        """Indexes contents and translations below ``path``, if that isn't done yet, and searches there from now on."""
        as_version = lambda df: df.withColumn("version", F.lit(RESOURCES))
        if self.contents is not None:
            self.content_index = SearchIndex(self.spark, f"{path}/contents", ["text"], "string")
            self.content_index.build(as_version(self.contents.withColumnRenamed("blob", "row")), [RESOURCES], force)
        if self.translations is not None:
            self.translation_index = SearchIndex(self.spark, f"{path}/translations", ["text"], "struct<path: string, key: string, from_ord: int>")
            rows = self.translations.select(F.struct("path", "key", "from_ord").alias("row"), F.concat_ws(" ", "key", "value").alias("text"))
            self.translation_index.build(as_version(rows), [RESOURCES], force)

    def resource_history(self, path: str) -> DataFrame:
        return self.runs.where(F.col("path") == path).orderBy("from_ord")
