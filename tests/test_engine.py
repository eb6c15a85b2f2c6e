"""The engine on the hand-sized symbol tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from verspan import schema
from verspan.engine import Engine, QueryError, split_owner_member
from verspan.store.parts import PartStore

#: versions, obfuscated, intermediary and the two named spellings
CLASSES = [
    ("2.0 2.1 3.0", "ka", "orchard/c_1", "orchard/plant/Tree", "org/orchard/flora/Tree"),
    ("2.0 2.1 3.0", "kb", "orchard/c_2", "orchard/fruit/Apple", "org/orchard/flora/fruit/Pome"),
    ("2.1 3.0", "kc", "orchard/c_3", "orchard/tool/Press", "org/orchard/gear/Squeezer"),
    ("2.0", "kd", "orchard/c_4", "orchard/tool/Barrel", "org/orchard/gear/Cask"),
    ("2.0 2.1", "ke", "orchard/c_5", "orchard/place/Cellar", "org/orchard/site/Cellar"),
    ("3.0", "ke", "orchard/c_5", "orchard/place/Vault", "org/orchard/site/Vault"),
    ("2.1", "kg", "orchard/c_7", "orchard/misc/Twin", "org/orchard/TwinA"),
    ("2.1", "kh", "orchard/c_8", "orchard/misc/Twin", "org/orchard/TwinB"),
]
#: versions, kind, obfuscated name and descriptor, intermediary name and descriptor, names; all of the class kb
MEMBERS = [
    ("2.0", "method", "a", "(Lka;)Lkb;", "m_11", "(Lorchard/c_1;)Lorchard/c_2;", "pick", "pluck"),
    ("2.1 3.0", "method", "a", "(Lka;)Lkb;", "m_11", "(Lorchard/c_1;)Lorchard/c_2;", "harvest", "pluck"),
    ("2.0 2.1 3.0", "method", "b", "()V", "m_12", "()V", "rot", "rot"),
    ("3.0", "method", "d", "()Z", "m_13", "()Z", "peel", "peeled"),
    ("2.0 2.1", "field", "c", "I", "f_21", "I", "weight", "mass"),
]
DECLS = [
    ("g/Plant", ["java/lang/Object"], [("grow", "(I)V"), ("age", "I")]), ("g/Edible", [], []), ("g/Fruit", ["g/Plant", "g/Edible"], [("seed", "J"), ("grow", "()V")]),
    ("g/Apple", ["g/Fruit"], [("core", "I")]), ("g/Pear", ["g/Fruit"], []), ("g/Granny", ["g/Apple"], []),
    ("g/Root", [], [("close", "()V"), ("open", "(I)V")]), ("g/Place", ["g/Root"], [("open", "(I)V")]), ("g/Farm", ["g/Place"], [("water", "()V"), ("dig", "()V")]),
]


@pytest.fixture(scope="module")
def engine(spark):
    versions = [(v, "release", None, None, "now", True, True, True, i, None, None, None, None) for i, v in enumerate(("2.0", "2.1", "3.0"))]
    classes, ids, members = [], {}, []
    for vs, obf, im, yarn, moj in CLASSES:
        for v in vs.split():
            ids[v, obf] = len(classes) + 1
            classes.append((v, len(classes) + 1, obf, im, yarn, moj, yarn.rpartition("/")[0], yarn.rpartition("/")[2], "both"))
    for vs, kind, obf, desc, im, im_desc, yarn, moj in MEMBERS:
        members += [(v, kind, 100 + len(members) + i, ids[v, "kb"], obf, desc, im, im_desc, im_desc, yarn, moj, yarn) for i, v in enumerate(vs.split())]
    decls = [("3.0", "mojmap", o, 0, s, [], m) for o, s, m in DECLS]
    refs = [("3.0", "mojmap", "g/Fruit", "grow:()V", "g/Farm", "water", "()V", "call", None, 3), ("3.0", "mojmap", "g/Farm", "water:()V", "g/Day", "dawn", "()V", "call", None, 1), ("3.0", "mojmap", "g/Fruit", "seed:J", "g/Farm", "water", "()V", "get", None, 1)]
    runs = [("fruit.csv", "h1", "text", 1, 0, 0), ("fruit.csv", "h2", "text", 1, 1, 2), ("img/leaf.png", "h3", "binary", 1, 0, 1), ("img/bark.png", "h4", "binary", 1, 2, 2)]
    apple = "class Apple {\n  int w;\n  void rot() { %s; }\n}\n"
    texts = [("2.0", "yarn", "Apple.java", apple % "w--"), ("2.1", "yarn", "Apple.java", apple % "w = 0"), ("2.1", "yarn", "Press.java", "class Press {}\n")]
    bodies = [("2.0", "mojmap", "g/Farm", "till", "()V", "call lambda$till$3 x"), ("2.1", "mojmap", "g/Farm", "till", "()V", "call lambda$till$7 x"), ("2.0", "mojmap", "g/Farm", "sow", "()V", "1"), ("2.0", "mojmap", "g/Farm", "sow", "(I)V", "2"), ("2.1", "mojmap", "g/Farm", "sow", "(I)V", "2")]
    code = [("3.0", "mojmap", "g/Farm", "water", "()V", t) for t in ("g/Sun:shine:()V", "g/Sun:shine:()V", "g/Rain:fall:()V")] + [("3.0", "mojmap", "g/Farm", "dig", "()V", "g/Sun:set:()V")]
    make = spark.createDataFrame
    return Engine(spark, make(versions, schema.VERSIONS), make(classes, schema.CLASSES), make(members, schema.MEMBERS), make(decls, schema.DECLS), make(refs, schema.REFS), make(runs, schema.RUNS), None, make(texts, schema.SOURCE_TEXT), make(bodies, schema.BODIES), make(code, schema.INSTRUCTIONS))


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


def keys(spark, *ks):
    return spark.createDataFrame([(k,) for k in ks], "key string")


def test_versions(engine):
    assert rows(engine.list_versions(), "version_id", "class_count", "method_count", "field_count") == [("2.0", 4, 2, 1), ("2.1", 6, 2, 1), ("3.0", 4, 3, 0)]
    assert engine.latest_release() == "3.0"
    assert rows(engine.version_range("3.0", "2.1"), "version_id") == [("2.1",), ("3.0",)]
    with pytest.raises(QueryError):
        engine.version_range("nope")


def test_diff(engine):
    one = sorted(rows(engine.diff("2.0", "2.1"), "bucket", "kind", "old_name", "new_name"), key=str)
    assert one == [("added", "class", None, "orchard/misc/Twin"), ("added", "class", None, "orchard/misc/Twin"), ("added", "class", None, "orchard/tool/Press"), ("removed", "class", "orchard/tool/Barrel", None), ("renamed", "method", "pick", "harvest")]
    two = sorted(rows(engine.diff("2.1", "3.0"), "bucket", "kind", "old_name", "new_name"), key=str)
    assert two == [("added", "method", None, "peel"), ("removed", "class", "orchard/misc/Twin", None), ("removed", "class", "orchard/misc/Twin", None), ("removed", "field", "weight", None), ("renamed", "class", "orchard/place/Cellar", "orchard/place/Vault")]
    assert engine.diff("2.0", "2.1", package="orchard/none").count() == 0
    assert engine.diff("2.0", "2.1", package="orchard/tool", kind="class").count() == 2
    assert sorted(rows(engine.diff_summary("2.0", "2.1"), "kind", "bucket", "n")) == [("class", "added", 3), ("class", "removed", 1), ("method", "renamed", 1)]


def test_search(engine):
    found = rows(engine.search("orchard", "3.0", ns="yarn"), "kind", "yarn_name")
    assert [k for k, _ in found] == ["class"] * 4 + ["method"] * 3
    assert rows(engine.search("Apple#har", "3.0", ns="yarn"), "yarn_name") == [("orchard/fruit/Apple#harvest",)]
    assert engine.search("rchar", "3.0", ns="yarn").count() == 7 and engine.search("rchar", "3.0", ns="yarn", exact=True).count() == 0
    assert split_owner_member("a/b/Class") is None and split_owner_member("Tree.leaf") == ("Tree", "leaf") and split_owner_member("a.b#c.d") == ("a.b#c", "d")


def test_search_ranks_over_the_whole_version(engine):
    """A filter by kind hides rows; it doesn't change the figures that the others are ranked by."""
    everything = {r["id"]: r["score"] for r in engine.search("orchard fruit", "2.1", ns="yarn").collect() if r["kind"] == "class"}
    assert everything == {r["id"]: r["score"] for r in engine.search("orchard fruit", "2.1", kind="class", ns="yarn").collect()} and everything


def test_translate_and_compare(engine, spark):
    apple, pome = "orchard/fruit/Apple", "org/orchard/flora/fruit/Pome"
    asked = [apple, f"{apple}:harvest", f"{apple}:harvest:(Lorchard/plant/Tree;)Lorchard/fruit/Apple;", "no/Such", f"{apple}:none", "orchard/misc/Twin"]
    got = dict(rows(engine.translate("2.1", keys(spark, *asked), "yarn", "mojmap"), "key", "result"))
    assert got == dict(zip(asked, [pome, f"{pome}:pluck", f"{pome}:pluck:(Lorg/orchard/flora/Tree;)L{pome};", None, None, None]))
    assert rows(engine.compare("2.1", apple), "kind", "yarn_name", "status") == [("method", "harvest", "different"), ("method", "rot", "same"), ("field", "weight", "different")]


def test_history(engine):
    assert rows(engine.history("orchard/tool/Press", "yarn"), "from", "to", "present", "versions") == [("2.0", "2.0", False, 1), ("2.1", "3.0", True, 2)]
    assert rows(engine.history("orchard/place/Vault", "yarn"), "from", "to", "present", "yarn_name") == [("2.0", "2.1", True, "orchard/place/Cellar"), ("3.0", "3.0", True, "orchard/place/Vault")]
    assert rows(engine.history("orchard.plant.Tree", "yarn"), "present", "versions") == [(True, 3)]
    assert rows(engine.history("no/Such", "yarn"), "present", "versions") == [(False, 3)]


def test_exists(engine, spark):
    want = {
        "g/Apple": (True, None, None), "g/None": (False, None, None), "g/Fruit:seed:J": (True, None, None), "g/Fruit:grow:(I)V": (False, "inherited", "g/Plant:grow:(I)V"), "g/Granny:age:I": (False, "inherited", "g/Plant:age:I"),
        "g/Apple:core": (False, "candidate", "g/Apple:core:I"), "g/Apple:core:()V": (False, "kind", "g/Apple:core:I"), "g/Fruit:grow:(J)V": (False, "descriptor", "g/Fruit:grow:()V"), "g/None:a:I": (False, None, None),
    }
    assert {r[0]: r[1:] for r in rows(engine.exists("3.0", "mojmap", keys(spark, *want)), "key", "exists", "reason", "nearest")} == want


def test_graphs(engine):
    nodes, edges = engine.hierarchy("3.0", "mojmap", "g/Fruit")
    assert rows(edges, "parent", "child") == [("g/Apple", "g/Granny"), ("g/Edible", "g/Fruit"), ("g/Fruit", "g/Apple"), ("g/Fruit", "g/Pear"), ("g/Plant", "g/Fruit")]
    assert rows(nodes, "simple_name") == [("Apple",), ("Edible",), ("Fruit",), ("Granny",), ("Pear",), ("Plant",)]
    with pytest.raises(QueryError):
        engine.hierarchy("3.0", "mojmap", "g/Unknown")
    assert rows(engine.references(["3.0"], ["g/Fruit:grow:()V"], "mojmap"), "ref_owner", "cnt") == [("g/Farm", 3)]
    assert rows(engine.call_chains("3.0", "mojmap", "g/Fruit:grow:()V"), "chain") == [("g/Day:dawn:()V > g/Farm:water:()V",)]


def test_resources(engine):
    assert rows(engine.resource_tree(2), "name", "is_dir") == [("img", True), ("fruit.csv", False)]
    assert sorted(rows(engine.resource_diff(0, 2), "path", "change")) == [("fruit.csv", "modified"), ("img/bark.png", "added"), ("img/leaf.png", "removed")]


def test_diff_class(engine):
    assert rows(engine.diff_class("2.0", "2.1", "orchard/fruit/Apple"), "bucket", "kind", "old_name", "new_name") == [("renamed", "method", "pick", "harvest")]
    assert rows(engine.diff_class("2.0", "2.1", "orchard/tool/Press"), "bucket", "kind") == [("added", "class")]
    assert engine.diff_class("2.0", "2.1", "no/Such").count() == 0


def test_patch_and_blame(engine):
    got = dict(rows(engine.diff_patch("2.0", "2.1", "yarn"), "path", "patch"))
    assert got["Apple.java"].endswith("-  void rot() { w--; }\n+  void rot() { w = 0; }\n }") and "new file mode" in got["Press.java"]
    assert list(dict(rows(engine.diff_patch("2.0", "2.1", "yarn", function="Apple#rot"), "path", "patch"))) == ["Apple.java"]
    assert rows(engine.blame("2.1", "yarn", "Apple.java"), "version_id") == [("2.0",), ("2.0",), ("2.1",), ("2.0",)]


def test_body_hash(engine):
    """The index of a lambda is no change of a body; a lost overload is."""
    spans = rows(engine.body_hash("mojmap", ["g/Farm:till", "g/Farm:sow:(I)V", "g/Farm:sow"], "2.0", "2.1"), "query", "from", "to", "versions")
    assert spans == [("g/Farm:sow", "2.0", "2.0", 1), ("g/Farm:sow", "2.1", "2.1", 1), ("g/Farm:sow:(I)V", "2.0", "2.1", 2), ("g/Farm:till", "2.0", "2.1", 2)]


def test_validate(engine):
    v = lambda *a: rows(engine.validate("mojmap", "g/Farm", *a, "2.1", "3.0"), "version_id", "status", "at_count", "moved_to", "closest", "reason")
    assert v("water", "()V", "g/Sun:shine") == [("2.1", "missing", None, None, None, "unknown-owner"), ("3.0", "ok", 2, None, None, None)]
    assert v("water", None, "g/Sun:set:()V")[1] == ("3.0", "call_moved", None, "g/Farm#dig", None, None)
    assert v("water", None, "g/Moon:rise:()V")[1] == ("3.0", "call_moved", None, None, None, "no-baseline")
    assert v("water", "(J)V", None)[1] == ("3.0", "renamed", None, None, "g/Farm:water:()V", None)
    assert v("open", "(I)V", None)[1] == ("3.0", "inherited", None, None, "g/Place:open:(I)V", None)
    assert v("close", "()V", None)[1] == ("3.0", "inherited", None, None, "g/Root:close:()V", None)
    assert v("open", "()V", None)[1] == ("3.0", "renamed", None, None, "g/Place:open:(I)V", None)
    assert v("gone", "()V", "g/Sun:set:()V")[1] == ("3.0", "missing", None, "g/Farm#dig", None, "unknown-target")


@pytest.fixture(scope="module")
def moving(spark, engine):
    """A call that leaves g/Farm for g/Barn in the second version of three, over references and instructions."""
    from dataclasses import replace

    make = spark.createDataFrame
    decls = [(v, "mojmap", o, 0, s, [], m) for v in ("2.0", "2.1", "3.0") for o, s, m in (*DECLS, ("g/Barn", [], [("water", "()V")]), ("org/orchard/flora/fruit/Pome", ["org/orchard/flora/Tree"], [("rot", "()V")]), ("org/orchard/flora/Tree", [], [("shade", "()V")]))]
    sun, farm, barn = ("g/Sun", "shine:()V"), ("g/Farm", "water", "()V"), ("g/Barn", "water", "()V")
    at = {"2.0": farm, "2.1": barn, "3.0": barn}
    refs = [(v, "mojmap", *sun, *site, "call", None, 1) for v, site in at.items()] + [("2.0", "mojmap", "g/Fruit", "seed:J", "g/Farm", "dig", "()V", "get", None, 1)]
    code = [("2.0", "mojmap", "g/Farm", "water", "()V", "g/Sun:shine:()V")]
    tree = [("2.0", "method", 901, 1, "s", "(Lkb;)V", "m_90", "()V", "()V", "shade", "shade", "shade")]
    members = engine.members.unionByName(make(tree, schema.MEMBERS))
    contents = [("h1", "ripe apples"), ("h2", "ripe pears and ripe plums"), ("h3", "bark")]
    words = [("lang/en.json", "fruit.apple", "Ripe Apple", 0, 1), ("lang/en.json", "fruit.pear", "Pear", 1, 2)]
    return replace(engine, decls=make(decls, schema.DECLS), refs=make(refs, schema.REFS), instructions=make(code, schema.INSTRUCTIONS), members=members, contents=make(contents, schema.CONTENTS), translations=make(words, schema.TRANSLATIONS))


def test_moved_calls(moving):
    assert rows(moving.diff_references("2.0", "2.1", "g/Sun:shine:()V", "mojmap"), "change", "site", "moved_to") == [("added", "g/Barn#water", None), ("moved", "g/Farm#water", "g/Barn#water"), ("removed", "g/Farm#water", None)]
    assert moving.diff_references("2.1", "3.0", "g/Sun", "mojmap").count() == 0
    v = lambda at, **k: rows(moving.validate_spans("mojmap", "g/Farm", "water", "()V", at, "2.0", "3.0", **k), "from", "to", "versions", "status", "at_count", "moved_to", "reason")
    assert v("g/Sun:shine:()V") == [("2.0", "2.0", 1, "ok", 1, None, None), ("2.1", "3.0", 2, "call_moved", None, "g/Barn#water", None)]
    assert v("g/Sun:shine")[1][5:] == (None, "at-without-descriptor")
    assert v("g/Sun:shine:()V", collapse="status")[1][:4] == ("2.1", "3.0", 2, "call_moved")


def test_reference_targets(moving):
    assert moving.normalise_target("2.0", "mojmap", "g/Granny:seed:J") == "g/Fruit:seed:J" and moving.normalise_target("2.0", "mojmap", "g/Granny:no:J") == "g/Granny:no:J"
    got = {r[0]: r[1:] for r in rows(moving.resolve_targets("2.0", "mojmap", ["g/Sun", "g/Sun:shine:()V", "g/Sun:shine", "g/Sun:shine:(I)V", "g/Sun:none:()V", "g/Moon"]), "target", "resolved", "candidates")}
    keys_ = ["g/Sun:shine:()V"]
    assert got == {"g/Sun": (True, []), "g/Sun:shine:()V": (True, []), "g/Sun:shine": (False, keys_), "g/Sun:shine:(I)V": (False, keys_), "g/Sun:none:()V": (True, []), "g/Moon": (False, [])}


def test_member_history(moving):
    h = lambda q, ns="yarn": moving.history(q, ns)
    spans = h("orchard/fruit/Apple:harvest")
    assert rows(spans, "from", "to", "type", "present", "owner") == [("2.0", "2.0", "method", True, "orchard/fruit/Apple"), ("2.1", "3.0", "method", True, "orchard/fruit/Apple")]
    first = spans.first()["members"][0]
    assert (first["yarn"], first["mojmap"], first["mojmap_descriptor"]) == ("pick", "pluck", "(Lorg/orchard/flora/Tree;)Lorg/orchard/flora/fruit/Pome;")
    assert rows(h("orchard.fruit.Apple:weight:I"), "type", "present", "versions") == [("field", True, 2), ("field", False, 1)]
    assert rows(h("orchard/fruit/Apple:none"), "type", "present", "versions") == [("unknown", False, 3)]
    assert rows(h("no/Such:none"), "type", "owner", "versions") == [("unknown", None, 3)]
    above = rows(h("org/orchard/flora/fruit/Pome:shade", "mojmap"), "from", "to", "type", "present", "reason", "declared_in")
    assert above == [("2.0", "2.0", "method", False, "inherited", "org/orchard/flora/Tree"), ("2.1", "3.0", "method", False, None, None)]


def test_diff_classes(engine):
    names = ["orchard/fruit/Apple", "orchard/tool/Press"]
    assert sorted(rows(engine.diff_classes("2.0", "2.1", names), "bucket", "kind", "truncated")) == [("added", "class", False), ("renamed", "method", False)]
    cut = rows(engine.diff_classes("2.0", "2.1", names + ["orchard/misc/Twin"], limit=1), "bucket", "kind", "truncated")
    assert sorted(cut) == [("added", "class", True), ("renamed", "method", True)]
    assert sorted(rows(engine.diff_classes_summary("2.0", "2.1", names), "kind", "bucket", "n")) == [("class", "added", 1), ("method", "renamed", 1)]
    with pytest.raises(QueryError):
        engine.diff_classes("2.0", "2.1", ["x"] * 26)


def test_search_includes_inherited_members(moving):
    found = rows(moving.search("Pome#shade", "2.0", ns="mojmap"), "mojmap_name")
    assert found == [("org/orchard/flora/Tree#shade",)]
    assert moving.search("Cask#shade", "2.0", ns="mojmap").count() == 0


def test_search_resources(moving):
    assert rows(moving.search_resources("ripe"), "path", "blob") == [("fruit.csv", "h1"), ("fruit.csv", "h2")]  # 2.2 / 1.975 against 4.4 / 3.9875 times the same
    assert rows(moving.search_resources("ripe", ord_=0), "blob") == [("h1",)]
    assert rows(moving.search_resources("ripe", "translation"), "key", "value") == [("fruit.apple", "Ripe Apple")]
    assert moving.search_resources("ripe", "translation", ord_=2).count() == 0
    with pytest.raises(QueryError):
        moving.search_resources("--")


def test_gates(engine):
    assert engine.first_unavailable("2.0", ["yarn", "mojmap", "obf"]) is None
    assert rows(engine.candidates("2.1", "x/Twin", "yarn"), "name") == [("orchard/misc/Twin",)] * 2
    assert rows(engine.unknown_versions(["2.0", "9"]), "version_id") == [("9",)]
    assert rows(engine.without_references(["2.0", "3.0"], "mojmap"), "version_id") == [("2.0",)]


def test_search_from_the_index(engine, spark, tmp_path):
    """The index answers as the scan does; a version without one is scanned."""
    from dataclasses import replace

    asked = [dict(query="orchard", ns="yarn"), dict(query="Apple#har", ns="yarn"), dict(query="rchar", ns="yarn"), dict(query="rchar", ns="yarn", exact=True), dict(query="orchard fruit"), dict(query="pome", kind="class"), dict(query="orchard.ro", limit=2, offset=1), dict(query="--"), dict(query="nothing at all", exact=True)]
    other = replace(engine)
    assert other.build_search_index(f"file://{tmp_path}/index", ["2.0", "3.0"]) == ["2.0", "3.0"] and other.build_search_index(f"file://{tmp_path}/index") == ["2.1"]
    other.build_search_index(f"file://{tmp_path}/index")
    shown = lambda df: [(r["kind"], r["id"], round(r["score"], 9)) for r in df.collect()]
    for i, q in enumerate(asked):
        v = ("3.0", "2.1", "2.0")[i % 3]
        assert shown(other.search(version_id=v, **q)) == shown(engine.search(version_id=v, **q))


def test_search_from_the_index_reads_no_tables(engine, tmp_path, monkeypatch):
    """The elements are stored beside their index: tables are joined once, when it is built, and ranked once in a search."""
    from dataclasses import replace

    built, unread = replace(engine), F.raise_error(F.lit("read")).isNull()
    assert built.build_search_index(f"file://{tmp_path}/index", ["3.0"]) == ["3.0"]
    built.classes, built.members = engine.classes.where(unread), engine.members.where(unread)
    asked = [dict(query="orchard", ns="yarn"), dict(query="orchard", ns="yarn", limit=2, offset=3), dict(query="orchard", ns="yarn", offset=99), dict(query="rchar", ns="yarn", offset=2), dict(query="har", kind="method", ns="yarn")]
    for q in asked:
        assert built.search(version_id="3.0", **q).collect() == engine.search(version_id="3.0", **q).collect()
    assert engine.search("orchard", "3.0", offset=99).count() == 0 and engine.search("orchard", "3.0").count() > 0
    # an index without stored elements gets them, one that has them is left as it is
    older = replace(engine)
    monkeypatch.setattr("verspan.engine.PartStore", lambda s, path, *a, **k: PartStore(s, f"{path}-anew", *a, **k))
    assert older.build_search_index(f"file://{tmp_path}/index", ["3.0"]) == [] and older.elements.missing(["3.0"]) == []
    assert older.search("orchard", "3.0", ns="yarn").collect() == engine.search("orchard", "3.0", ns="yarn").collect()


def test_search_finds_letters_without_their_marks(engine, spark, tmp_path):
    from dataclasses import replace

    marked = replace(engine, classes=engine.classes.withColumn("yarn_name", F.replace("yarn_name", F.lit("Apple"), F.lit("Äpple"))))
    marked.build_search_index(f"file://{tmp_path}/index")
    assert rows(marked.search("apple", "3.0", kind="class", ns="yarn"), "yarn_name") == rows(marked.search("äpple", "3.0", kind="class", ns="yarn"), "yarn_name") == [("orchard/fruit/Äpple",)]


def test_side_indexes(engine, spark, tmp_path):
    """Everything that reads declarations and references gives the same from the side indexes, and of what isn't built by a scan."""
    from dataclasses import replace

    other = replace(engine)
    built = other.build_side_indexes(f"file://{tmp_path}/side", [("3.0", "mojmap")])
    assert built == {"decls": [("3.0", "mojmap")], "refs": [("3.0", "mojmap")]}
    assert other.build_side_indexes(f"file://{tmp_path}/side", [("3.0", "mojmap")]) == {"decls": [], "refs": []}
    empty = engine.decls.limit(0)
    other.decls, other.refs = empty, engine.refs.limit(0)
    ask = [
        lambda e: e.exists("3.0", "mojmap", keys(spark, "g/Fruit:seed:J", "g/Apple:grow:()V", "g/Nope:x")),
        lambda e: e.hierarchy("3.0", "mojmap", "g/Fruit")[1], lambda e: e.references(["3.0"], ["g/Fruit:grow:()V", "g/Fruit:seed:J"], "mojmap"), lambda e: e.call_chains("3.0", "mojmap", "g/Fruit:grow:()V"),
        lambda e: e.resolve_targets("3.0", "mojmap", ["g/Fruit:grow:()V", "g/Fruit:none"]),
    ]
    for f in ask:
        want = sorted(map(str, f(engine).collect()))
        assert want and sorted(map(str, f(other).collect())) == want
    assert other.exists("2.0", "mojmap", keys(spark, "g/Fruit:seed:J")).first()["exists"] is False  # not built, and the scanned table is empty


def test_body_hash_by_intermediary_names(engine, spark):
    """A class that is renamed between versions leaves the hash of what names it alone; a renamed member doesn't."""
    from dataclasses import replace

    call = "182 {%s} %s ({%s})V\n177"
    bodies = [("2.1", "yarn", "o/Q", "run", "()V", call % ("orchard/place/Cellar", "stock", "orchard/fruit/Apple")), ("3.0", "yarn", "o/Q", "run", "()V", call % ("orchard/place/Vault", "stock", "orchard/fruit/Apple")),
              ("2.1", "yarn", "o/Q", "go", "()V", call % ("orchard/place/Cellar", "stock", "java/lang/String")), ("3.0", "yarn", "o/Q", "go", "()V", call % ("orchard/place/Vault", "stack", "java/lang/String"))]
    e = replace(engine, bodies=spark.createDataFrame(bodies, schema.BODIES))
    spans = lambda n: rows(e.body_hash("yarn", ["o/Q:run", "o/Q:go"], "2.1", "3.0", n), "query", "versions")
    assert sorted(spans("none")) == [("o/Q:go", 1), ("o/Q:go", 1), ("o/Q:run", 1), ("o/Q:run", 1)]
    assert sorted(spans("intermediary")) == [("o/Q:go", 1), ("o/Q:go", 1), ("o/Q:run", 2)]
    with pytest.raises(QueryError):
        e.body_hash("yarn", ["o/Q:run"], "2.1", "3.0", "nothing")


def test_hierarchies_of_all_classes(engine, spark):
    """Flags of nodes; the whole graph of every class at once equals that of each."""
    from dataclasses import replace

    access = {"h/A": 0x421, "h/I": 0x601, "h/B": 1, "h/C": 1, "h/D": 0x10, "java/lang/Object": 1}
    supers = {"h/A": ["java/lang/Object"], "h/I": ["java/lang/Object"], "h/B": ["h/A", "h/I"], "h/C": ["h/B", "far/Lib"], "h/D": ["h/B", "h/I"], "java/lang/Object": []}
    e = replace(engine, decls=spark.createDataFrame([("3.0", "mojmap", o, access[o], s, [], []) for o, s in supers.items()], schema.DECLS))
    nodes, edges = e.hierarchy("3.0", "mojmap", "h/B")
    assert [tuple(r) for r in nodes.collect()] == [("h/A", "A", False, True), ("h/B", "B", False, False), ("h/C", "C", False, False), ("h/D", "D", False, False), ("h/I", "I", True, True)]
    assert rows(edges, "parent", "child") == [("h/A", "h/B"), ("h/B", "h/C"), ("h/B", "h/D"), ("h/I", "h/B")]
    all_nodes, all_edges = e.hierarchies("3.0", "mojmap")
    for root in supers:
        one = e.hierarchies("3.0", "mojmap", [root])
        for whole, own in zip((all_nodes, all_edges), one):
            assert sorted(map(str, whole.where(F.col("root") == root).collect())) == sorted(map(str, own.collect()))
    label = {r["owner"]: r for r in e.superclass_labels("mojmap").collect()}
    below = lambda x, y: label[y]["first"] < label[x]["first"] <= label[y]["last"]
    up = {x: s[0] if s and s[0] in supers else None for x, s in supers.items()}
    for x in supers:
        chain, at = set(), up[x]
        while at:
            chain.add(at)
            at = up[at]
        assert {y for y in supers if below(x, y)} == chain and label[x]["depth"] == len(chain)


def test_tree_labels_of_a_deep_chain_and_a_cycle(spark):
    from verspan.operators.graph import tree_labels

    t = [("v", f"n{i}", f"n{i - 1}" if i else None) for i in range(100)] + [("v", "x", "y"), ("v", "y", "x"), ("v", "z", "x"), ("w", "n5", "n4")]
    got = {(r["v"], r["k"]): (r["depth"], r["first"], r["last"]) for r in tree_labels(spark.createDataFrame(t, "v string, k string, p string"), ["v"], "k", "p").collect()}
    assert got == {("v", f"n{i}"): (i, i + 1, 100) for i in range(100)} | {("w", "n5"): (0, 1, 1)}


def test_caps_and_names_of_versions(engine, spark):
    from dataclasses import replace

    many = spark.createDataFrame([(f"9.{i}", "release", None, None, "now", True, True, True, i, None, None, None, None) for i in range(70)], schema.VERSIONS)
    wide = replace(engine, versions=many, resource_versions=spark.createDataFrame([(0, "m0", "First", "2.0", None, None), (1, "m1", "Second", None, None, None)], schema.RESOURCE_VERSIONS))
    for ask in (lambda: wide.body_hash("mojmap", ["g/Farm:till"]), lambda: wide.validate("mojmap", "g/Farm", "water", None, None, "9.0", "9.69"), lambda: wide.references([f"9.{i}" for i in range(26)], ["a:b"], "mojmap"),
                lambda: wide.references(["9.0"], [f"a:{i}" for i in range(2001)], "mojmap"), lambda: wide.body_hash("mojmap", [f"a:{i}" for i in range(51)], "9.0", "9.1"), lambda: wide.call_chains("3.0", "mojmap", "a:b", depth=6),
                lambda: wide.exists("3.0", "mojmap", keys(spark, *[f"a:{i}" for i in range(2001)]))):
        with pytest.raises(QueryError):
            ask()
    assert wide.body_hash("mojmap", ["g/Farm:till"], "9.0", "9.59").count() == 1
    assert [wide.ord_of(x) for x in ("m0", "Second", "2.0")] == [0, 1, 0]
    with pytest.raises(QueryError):
        wide.ord_of("Third")


def test_resource_file(engine):
    assert rows(engine.resource_file("fruit.csv", 1), "blob", "content_type") == [("h2", "application/octet-stream")]
    assert rows(engine.resource_file("img/leaf.png", 0), "blob", "content_type") == [("h3", "image/png")] and engine.resource_file("img/leaf.png", 2).count() == 0


def test_search_resources_from_the_index(moving, tmp_path):
    from dataclasses import replace

    other = replace(moving)
    other.build_resource_index(f"file://{tmp_path}/resources")
    for ask in (dict(query="ripe"), dict(query="ripe", ord_=0), dict(query="ripe", kind="translation"), dict(query="ripe", kind="translation", ord_=2), dict(query="nothing")):
        assert list(map(str, other.search_resources(**ask).collect())) == list(map(str, moving.search_resources(**ask).collect()))


def test_counts_of_versions(engine, spark):
    """Stored counts are taken as they are; versions without them are counted."""
    from dataclasses import replace

    known = engine.versions.withColumns({n: F.when(F.col("version_id") == "2.0", 9).cast("bigint") for n in ("class_count", "method_count", "field_count")})
    assert rows(replace(engine, versions=known).list_versions(), "version_id", "class_count", "method_count", "field_count") == [("2.0", 9, 9, 9), ("2.1", 6, 2, 1), ("3.0", 4, 3, 0)]
    whole = known.fillna(1, ["class_count", "method_count", "field_count"])
    assert rows(replace(engine, versions=whole, classes=None, members=None).list_versions(), "class_count") == [(9,), (1,), (1,)]  # nothing is scanned
