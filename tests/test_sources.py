"""Listings and JSON metadata."""

from __future__ import annotations

from pyspark.sql import functions as F

from verspan.sources import jsonmeta as J
from verspan.sources import listing as L


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def listing(spark, *names):
    return spark.createDataFrame([(f"/s/{n}", i) for i, n in enumerate(names)], "path string, modified long")


def test_highest_build(spark):
    d = listing(spark, "1.21-build.9.tiny", "1.21-build.10.tiny", "1.21-build.11-constants.tiny", "1.20-build.1.tiny", "x.txt")
    assert rows(L.highest_build(d), "version_id", "build") == [("1.20", 1), ("1.21", 10)]


def test_pairs_and_preference(spark):
    d = listing(spark, "1.21.txt", "1.21-client.txt", "1.20-client.txt", "1.20-server.txt")
    assert rows(L.mapping_pairs(d), "version_id", "paths") == [("1.20", ["/s/1.20-client.txt", "/s/1.20-server.txt"]), ("1.21", ["/s/1.21.txt"])]
    a = spark.createDataFrame([("1.21", "a")], "version_id string, path string")
    b = spark.createDataFrame([("1.21", "b"), ("one20", "c")], "version_id string, path string")
    assert rows(L.preferred([a, b], {"one20": "1.20"}), "version_id", "path") == [("1.20", "c"), ("1.21", "a")]


def test_universe_resolve_and_changes(spark):
    ids = lambda *x: spark.createDataFrame([(i, f"p{i}") for i in x], "version_id string, path string")
    assert rows(L.universe([ids("a", "b"), ids("b", "c")], ids("b", "c")), "version_id") == [("b",), ("c",)]
    r = L.resolve(ids("a", "b"), ids("a"), ids("b"), ids())
    assert rows(r, "version_id", "has_yarn", "has_intermediary", "has_mojmap") == [("a", True, False, False), ("b", False, True, False)]
    assert rows(L.changed_listing(listing(spark, "a", "b"), listing(spark, "a", "c", "b")), "path") == [("/s/b",), ("/s/c",)]
    p = spark.createDataFrame([("1.21", "1.21-")], "version_id string, prefix string")
    assert rows(L.first_by_prefix(listing(spark, "1.21-b.jar", "1.21-a.jar", "1.2.jar"), p), "path") == [("/s/1.21-a.jar",)]


def test_json(spark):
    h = "a" * 40
    f = spark.createDataFrame([(f"/m/1.21_{h}.json", 1, '{"type": "old"}'), (f"/m/1.21_{h[:-1]}b.json", 2, '{"type": "release", "releaseTime": "t", "libraries": [{"downloads": {"artifact": {"path": "g/x.jar"}}}, {"downloads": {"artifact": {"path": "g/y.jar"}}}, {}]}')], "path string, modified long, value string")
    assert rows(J.catalog(f), "version_id", "release_type", "release_time") == [("1.21", "release", "t")]
    s = J.semver_cache(spark.createDataFrame([('{"1.21": "1.21.0", "b": "2"}',)], "value string"))
    assert {r["version_id"] for r in J.catalog(f, s).collect()} == {"1.21", "b"}
    assert rows(J.libraries(f, listing(spark, "x.jar")), "library") == [("x.jar",)]
    assert J.protocol_version(f.withColumn("value", F.lit('{"protocol_version": 767}'))).first()["protocol_version"] == 767


def test_list_files(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.tiny").write_text("x")
    (tmp_path / "b.txt").write_text("y")
    assert [r["path"].rpartition("/")[2] for r in L.list_files(spark, str(tmp_path), "*.tiny").collect()] == ["a.tiny"]


def test_versions_ranked_and_variants(spark):
    from verspan.functions.text import is_commit_id, is_stable, named_index
    from verspan.sources.listing import ranked, universe, with_variants

    v = spark.createDataFrame([("1.10", 0, None), ("1.9", 1, None), ("1.9_unobfuscated", None, None), ("odd_unobfuscated", 3, None), ("1.10-pre1", 4, None)], "version_id string, sort_index int, variant_of string")
    got = {r["version_id"]: (r["sort_index"], r["moved"], r["variant_of"]) for r in with_variants(ranked(v)).collect()}
    assert sorted(got, key=lambda k: got[k][0]) == ["1.9_unobfuscated", "1.9", "1.10-pre1", "1.10", "odd_unobfuscated"] and {x[0] for x in got.values()} == set(range(5))
    assert got["1.9_unobfuscated"][2] == "1.9" and got["odd_unobfuscated"][2] is None and got["1.10-pre1"][0] < got["1.10"][0]
    assert not any(r["moved"] for r in ranked(ranked(v).drop("moved")).collect())
    ids = lambda *xs: spark.createDataFrame([(x,) for x in xs], "version_id string")
    assert [r["version_id"] for r in universe([ids("1.10", "zzz"), ids("1.9", "1.10", "gone")], ids("1.9", "1.10", "zzz")).collect()] == ["1.9", "1.10", "zzz"]
    stable = spark.createDataFrame([("1.9", None), ("1.9_unobfuscated", "release"), ("1.10", "snapshot"), ("25w01a", "release")], "v string, k string").select("v", is_stable(F.col("v"), F.col("k")).alias("s"))
    assert dict(map(tuple, stable.collect())) == {"1.9": True, "1.9_unobfuscated": False, "1.10": False, "25w01a": True}
    tokens = spark.createDataFrame([("a" * 40,), ("A" * 40,), ("0" * 64,), ("0" * 41,), ("main",)], "t string").select(is_commit_id(F.col("t")).alias("x"))
    assert [r["x"] for r in tokens.collect()] == [True, False, True, False, False]
    spaces = spark.createDataFrame([(["official", "yarn", "x"],), (["official", "named"],), (["official", "other", "last"],)], "n array<string>").select(named_index(F.col("n"), "yarn").alias("i"))
    assert [r["i"] for r in spaces.collect()] == [1, 1, 2]


def test_decorated_members(spark):
    from verspan.operators.correspondence import decorated, official_as_mojmap
    from verspan.sources.tiny import parse_tiny

    text = "tiny\t2\t0\tofficial\tintermediary\nc\tg/Tree\tc_1\n\tm\t(Lg/Leaf;)Lg/Tree;\tgrow\tm_1\n\tf\tI\tage\tf_1\nc\tg/Leaf\tc_2\n"
    mapping = parse_tiny(spark.createDataFrame([("a", text)], "path string, value string"))
    scanned = spark.createDataFrame([("g/Tree", "grow", "(Lg/Leaf;)Lg/Tree;"), ("g/Tree", "age", "I"), ("g/Tree", "age", "J"), ("g/New", "age", "I")], "owner string, name string, descriptor string")
    got = {(r["owner"], r["name"], r["descriptor"]): (r["intermediary_name"], r["intermediary_desc"]) for r in decorated(scanned, mapping).collect()}
    assert got == {("g/Tree", "grow", "(Lg/Leaf;)Lg/Tree;"): ("m_1", "(Lc_2;)Lc_1;"), ("g/Tree", "age", "I"): ("f_1", "I"), ("g/Tree", "age", "J"): (None, None), ("g/New", "age", "I"): (None, None)}
    rows = spark.createDataFrame([("a", None, "yarn_only")], "obf_name string, mojmap_name string, presence string")
    assert tuple(official_as_mojmap(rows).first()) == ("a", "a", "both")


def test_an_archive_is_read_by_several_tasks(spark, tmp_path):
    """A jar of 10,000 classes is dealt out; its rows are those of the whole-file reader."""
    import zipfile

    from verspan.sources.archives import register
    from verspan.sources.classfile import read_declarations, simple_class
    from verspan.sources.tiny import parse_tiny

    (tmp_path / "more").mkdir()
    with zipfile.ZipFile(tmp_path / "big.jar", "w", zipfile.ZIP_DEFLATED) as z:
        for i in range(10_000):
            z.writestr(f"p/C{i}.class", simple_class(f"p/C{i}", "p/Base", [("x", "I")]))
        z.writestr("mappings/mappings.tiny", "tiny\t2\t0\tofficial\tnamed\nc\ta\tp/C1\n")
    with zipfile.ZipFile(tmp_path / "more" / "small.jar", "w") as z:
        z.writestr("q/D.class", simple_class("q/D", "p/C1"))
        z.writestr("readme.txt", "no class")
    register(spark)
    read = lambda **o: spark.read.format("archive_entries").options(**o).load(f"file://{tmp_path}")
    entries = read(splitBytes=200_000)
    assert entries.rdd.getNumPartitions() > 5
    whole = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jar").load(f"file://{tmp_path}")
    shown = lambda files: sorted(map(str, read_declarations(files).collect()))
    got = shown(entries)
    assert len(got) == 10_001 and got == shown(whole) == shown(read())
    tiny = parse_tiny(read(pattern="*.tiny").selectExpr("path", "cast(content as string) as value"))
    assert [r["owner"] for r in tiny.collect()] == ["a"]
    (tmp_path / "none").mkdir()
    assert spark.read.format("archive_entries").load(f"file://{tmp_path}/none").count() == 0


def test_single_classes_on_demand(spark, tmp_path):
    import zipfile

    from verspan.sources.archives import headers_above, hit_counts, register
    from verspan.sources.classfile import simple_class

    with zipfile.ZipFile(tmp_path / "a.jar", "w") as z:
        for name, parent in (("p/A", "p/B"), ("p/B", "p/C"), ("p/C", "java/lang/Object"), ("p/X", "p/A")):
            z.writestr(f"{name}.class", simple_class(name, parent, [], [("run", "()V"), ("stop", "(I)V")], [("p/T", "go", "()V")] * 2 + [("p/T", "go", "(I)V")]))
    register(spark)
    path = f"file://{tmp_path}"
    assert {r["owner"]: r["supertypes"] for r in headers_above(spark, path, ["p/A", "p/none"]).collect()} == {"p/A": ["p/B"], "p/B": ["p/C"], "p/C": ["java/lang/Object"]}
    shown = lambda at: sorted(tuple(r) for r in hit_counts(spark, path, "p/X", at).collect())
    assert shown("p/T:go:()V") == [("run", "()V", 2), ("stop", "(I)V", 2)] and shown("p/T:go") == [("run", "()V", 3), ("stop", "(I)V", 3)] and shown("p/U") == [("run", "()V", 0), ("stop", "(I)V", 0)]
    assert hit_counts(spark, path, "p/none", "p/T:go").count() == 0
