"""Column functions: descriptors, names, semantic versions, keys and export formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def map_types(descriptor: Column, names: Column) -> Column:
    """Rewrite each ``L...;`` of a descriptor by a map; unknown types and an unterminated tail stay."""
    parts = F.regexp_extract_all(descriptor, F.lit("L[^;]+;|L[^;]*$|[^L]"), 0)

    def one(p: Column) -> Column:
        inner = F.regexp_extract(p, "^L([^;]+);$", 1)
        return F.when(inner != "", F.concat(F.lit("L"), F.coalesce(names[inner], inner), F.lit(";"))).otherwise(p)

    return F.array_join(F.transform(parts, one), "")


def types_in(body: Column) -> Column:
    """The classes that a method body names, each once."""
    return F.array_distinct(F.regexp_extract_all(body, F.lit(r"\{([^{}]*)\}"), 1))


def rename_types(body: Column, names: Column) -> Column:
    """A method body with its classes renamed by a map; others stay."""
    parts = F.regexp_extract_all(body, F.lit(r"\{[^{}]*\}|[^{}]+"), 0)
    inner = lambda p: F.substring(p, F.lit(2), F.length(p) - 2)
    return F.array_join(F.transform(parts, lambda p: F.when(p.startswith("{"), F.concat(F.lit("{"), F.coalesce(F.try_element_at(names, inner(p)), inner(p)), F.lit("}"))).otherwise(p)), "")


def simple_name(name: Column) -> Column:
    return F.substring_index(F.substring_index(name, "/", -1), "$", -1)


def package_path(name: Column) -> Column:
    return F.regexp_extract(name, "^(.*)/[^/]*$", 1)


def outer_class(name: Column) -> Column:
    return F.substring_index(name, "$", 1)


def real_name(name: Column) -> Column:
    """Null for placeholder names such as method_12."""
    return F.when(~F.coalesce(name.rlike("^(method_|field_)[0-9]+$"), F.lit(False)), name)


def lambda_owner(name: Column) -> Column:
    """The method that a lambda's synthetic name stands for; other names stay."""
    inner = F.regexp_extract(name, r"^lambda\$(.*)\$\d+$", 1)
    return F.when(inner == "new", "<init>").when(inner == "static", "<clinit>").when(inner != "", inner).otherwise(name)


def strip_lambda_index(text: Column) -> Column:
    """Lambda names anywhere in a text without their index, which any lambda added before them shifts."""
    return F.regexp_replace(text, r"lambda\$([^$\s()]+)\$\d+", r"lambda\$$1")


def squeeze(text: Column) -> Column:
    return F.regexp_replace(F.trim(text), r"\s+", " ")


def body_hash(bodies: Column) -> Column:
    """16 hexadecimal digits of SHA-256 over an array of (descriptor, body) in order of the descriptors."""
    texts = F.transform(F.array_sort(bodies), lambda b: F.concat(b["descriptor"], F.lit("\n"), strip_lambda_index(b["body"])))
    return F.substring(F.sha2(F.concat_ws("\n", texts), 256), 1, 16)


def semver(version: Column) -> Column:
    """Sort key of a version text; null if it is none.

    Numbers sort before words in a pre-release, a shorter one first, a release after
    its pre-releases, build metadata after none.
    """
    core = F.regexp_extract(version, r"^(\d+(?:\.\d+){0,2})(?=$|[-_ +])", 1)
    nums = F.split(core, r"\.")
    rest = F.regexp_extract(version, r"^\d+(?:\.\d+){0,2}[-_ ]([^+]*)", 1)
    build = F.regexp_extract(version, r"\+(.*)$", 1)
    ids = F.when(rest == "", F.array().cast("array<string>")).otherwise(F.split(rest, r"[-_ .]"))
    ids = F.transform(ids, lambda x, i: F.when(i == 0, F.replace(F.lower(x), F.lit("snapshot"), F.lit("alpha"))).otherwise(x))
    pre = F.transform(ids, lambda x: F.struct((~x.rlike("^[0-9]+$")).cast("int").alias("word"), F.coalesce(F.when(x.rlike("^[0-9]+$"), x.cast("long")), F.lit(0).cast("long")).alias("num"), F.when(x.rlike("^[0-9]+$"), "").otherwise(x).alias("text")))
    part = lambda i: F.coalesce(F.get(nums, F.lit(i)).cast("long"), F.lit(0).cast("long"))
    return F.when(core != "", F.struct(part(0).alias("major"), part(1).alias("minor"), part(2).alias("patch"), (rest == "").cast("int").alias("release"), pre.alias("pre"), (build != "").cast("int").alias("built"), build.alias("build")))


def release_type(version: Column) -> Column:
    v = F.lower(version)
    kind = F.when(v.contains("rc"), "release-candidate").when(v.contains("pre"), "pre-release").when(version.rlike(r"^\d+w\d+[a-z]?$"), "snapshot")
    return kind.when(version.rlike(r"^\d+\.\d+(\.\d+)?$"), "release").otherwise("snapshot")


#: Fixed value: how a version is named that is built from another one's names.
VARIANT = "_unobfuscated"


def variant_base(version: Column) -> Column:
    """The version that a variant is named after; null for others."""
    return F.when(version.endswith(VARIANT), F.substring(version, F.lit(1), F.length(version) - len(VARIANT)))


def is_stable(version: Column, kind: Column) -> Column:
    """Releases that are no variants; without a known kind the id says it."""
    return variant_base(version).isNull() & (F.coalesce(kind, release_type(version)) == "release")


def is_commit_id(token: Column) -> Column:
    """40 or 64 hexadecimal digits in lower case."""
    return token.rlike("^[0-9a-f]{40}([0-9a-f]{24})?$")


def named_index(namespaces: Column, *aliases: str) -> Column:
    """Place of the named namespace: the first that is called ``named`` or by an alias, else the last; from 0."""
    found = F.array_position(F.transform(namespaces, lambda n: n.isin("named", *aliases)), True)
    return F.when(found > 0, found - 1).otherwise(F.size(namespaces) - 1)


def content_type(path: Column) -> Column:
    kinds = {"json": "application/json", "mcmeta": "application/json", "png": "image/png", "ogg": "audio/ogg", "txt": "text/plain", "html": "text/html", "nbt": "application/octet-stream"}
    ext, out = F.lower(F.substring_index(path, ".", -1)), None
    for k, v in kinds.items():
        out = F.when(ext == k, v) if out is None else out.when(ext == k, v)
    return out.otherwise("application/octet-stream")


def export_key(owner: Column, name: Column, descriptor: Column, form: str) -> Column:
    """access widener, access transformer, mixin target or reference key of a method."""
    return {
        "aw": F.format_string("accessible method %s %s %s", owner, name, descriptor),
        "at": F.format_string("public %s %s%s", F.replace(owner, F.lit("/"), F.lit(".")), name, descriptor),
        "mixin": F.format_string("L%s;%s%s", owner, name, descriptor),
        "key": F.format_string("%s:%s:%s", owner, name, descriptor),
    }[form]


def key_parts(key: Column) -> tuple[Column, Column, Column]:
    parts = F.split(key, ":", 3)
    return F.get(parts, F.lit(0)), F.get(parts, F.lit(1)), F.get(parts, F.lit(2))
