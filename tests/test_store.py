"""Stored tables: parts with a registry, the search index, side indexes, growing runs."""

from __future__ import annotations

import random
import uuid
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from verspan.operators import search as X
from verspan.operators import spans as S
from verspan.store.parts import PartStore
from verspan.store.runs import GrowingRuns, blob_kind, changes_of
from verspan.store.search_index import SearchIndex, fold, folded
from verspan.store.side_index import SideIndex, pair


@pytest.fixture
def place(tmp_path):
    return f"file://{tmp_path}/{uuid.uuid4().hex}"


def tuples(df, *cols):
    return sorted((tuple(r[c] for c in cols or df.columns) for r in df.collect()), key=str)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


# parts

def test_parts(spark, place):
    rows = spark.createDataFrame([("a b", 1, "x"), ("a b", 2, "y"), ("2020", 3, "x"), ("z=1", 4, "x")], "v string, k int, s string")
    store = PartStore(spark, place, "v string, k int, s string", "v", ["s"], ["k"])
    assert store.read().count() == 0 and store.missing(["2020", "a b"]) == ["2020", "a b"]
    store.write(rows, ["a b", "2020", "none"], {"even": F.col("k") % 2 == 0})
    assert tuples(store.read()) == [("2020", 3, "x"), ("a b", 1, "x"), ("a b", 2, "y")]
    built = store.built()
    assert {p: (b["rows"], b["even"]) for p, b in built.items()} == {"a b": (2, 1), "2020": (1, 0), "none": (0, 0)}
    assert store.missing(["2020", "z=1", "none"]) == ["z=1"] and store.missing(["2020"], force=True) == ["2020"]
    # built again: readers follow the last build, the others' files go
    store.write(rows.withColumn("k", F.col("k") + 10), ["2020"])
    store.write(rows, ["z=1"])
    assert tuples(store.read(["2020", "z=1"])) == [("2020", 13, "x"), ("z=1", 4, "x")]
    store.clean()
    assert tuples(store.read(["2020", "a b"])) == [("2020", 13, "x"), ("a b", 1, "x"), ("a b", 2, "y")]


def test_many_parts_in_several_builds(spark, place, monkeypatch):
    monkeypatch.setattr("verspan.store.parts.AT_ONCE", 3)
    rows = spark.createDataFrame([(f"v{i % 8}", i) for i in range(40)], "v string, k int")
    store = PartStore(spark, place, "v string, k int", "v")
    assert store.write(rows, [f"v{i}" for i in range(8)]) == [f"v{i}" for i in range(8)]
    assert len({b["build"] for b in store.built().values()}) == 3 and {b["rows"] for b in store.built().values()} == {5}
    assert tuples(store.read()) == tuples(rows) and tuples(store.read(["v7"])) == [("v7", i) for i in (15, 23, 31, 39, 7)]


def test_parts_torn_build(spark, place, monkeypatch):
    rows = spark.createDataFrame([("a", 1)], "v string, k int")
    store = PartStore(spark, place, "v string, k int", "v")

    def torn(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(PartStore, "register", torn)
    with pytest.raises(RuntimeError):
        store.write(rows, ["a"])
    monkeypatch.undo()
    assert store.read().count() == 0 and store.missing(["a"]) == ["a"]  # files are there, but nobody reads them
    store.write(rows, store.missing(["a"]))
    store.clean()
    assert tuples(store.read()) == [("a", 1)]


# the search index

WORDS = ["the", "then", "élan", "elan", "Straße", "of", "of_the", "THE", "a1", "1b", "Überall", "über", "Ωmega", "naïve", "x"]


def test_index_equals_scan(spark, place):
    rng = random.Random(3)
    texts = [(i, rng.choice(["v1", "v2"]), " ".join(rng.choices(WORDS, k=rng.randrange(12))) if i % 17 else None) for i in range(200)]
    rows = spark.createDataFrame(texts, "row long, version string, text string")
    index = SearchIndex(spark, place, ["text"])
    assert index.build(rows, ["v1", "v2", "v3"]) == ["v1", "v2", "v3"] and index.build(rows, ["v1", "v2", "v3"]) == []
    for version in ("v1", "v2"):
        own = rows.where(F.col("version") == version)
        for phrases in ([("the", True)], [("of the", False)], [("the", False), ("o", True)], [("x x", False)], [("über", False), ("1", True)], [("the the", True)], [("missing", False)]):
            want = tuples(X.bm25(own, "row", "text", phrases).select("row", F.round("score", 9).alias("s")))
            assert tuples(index.bm25(version, phrases, exact=True).select("row", F.round("score", 9).alias("s"))) == want
        tf = tuples(X.phrase_tf(own, "row", "text", "of the"))
        assert tuples(index.bm25(version, [("of the", False)], exact=True).select("row", "tf0")) == tf
    assert index.bm25("v3", [("the", False)]).count() == 0
    assert index.versions()["v1"]["n"] == rows.where("version = 'v1'").count()


def test_index_has_a_posting_for_each_token_of_a_row(spark, place):
    rows = spark.createDataFrame([(1, "v", "The the élan the elan"), (2, "v", None)], "row long, version string, text string")
    index = SearchIndex(spark, place, ["text"])
    index.build(rows, ["v"])
    kept = index.store.read(["v"]).where("lead <> 'rows'")
    assert tuples(kept, "row", "token", "written", "pos", "lens") == [(1, "elan", "élan", [2], [5]), (1, "elan", None, [4], [5]), (1, "the", None, [0, 1, 3], [5])]
    assert tuples(index.postings("v", "elan", False), "row", "written", "pos") == [(1, "elan", 4), (1, "élan", 2)]
    hits = index.hits("v", [("the", False), ("élan", False)], exact=True)
    assert tuples(hits, "row", "dl", "tf0", "tf1") == [(1, 5, 3, 1)]


def test_single_words_are_summed_before_they_are_shuffled(spark, place):
    """As an engine's search of names asks them."""
    index = SearchIndex(spark, place, ["x", "y"], "struct<kind: int, id: int>")
    index.build(spark.createDataFrame([((1, 2), "v", "c1 c1", "c12")], "row struct<kind: int, id: int>, version string, x string, y string"), ["v"])
    found = index.hits("v", [("c1", True)])
    plan = plan_of(found)
    assert "Generate" not in plan and "partial_sum" in plan.split("Exchange")[1]
    assert [(tuple(r["row"]), r["dl"], r["tf0"]) for r in found.collect()] == [((1, 2), 3, 3)]


def test_builds_deal_out_a_bounded_number_of_tokens(spark, place, monkeypatch):
    """A task's postings are sorted in memory, however well its texts are compressed."""
    monkeypatch.setattr("verspan.store.search_index.TOKENS_AT_ONCE", 100)
    seen, write = [], PartStore.write
    monkeypatch.setattr(PartStore, "write", lambda self, rows, *a, **k: seen.append(rows) or write(self, rows, *a, **k))
    rows = spark.createDataFrame([(i, v, "a b " * 5, None) for i in range(45) for v in ("v", "w")], "row long, version string, x string, y string")
    for n, versions in enumerate((["v"], ["v", "w"]), 1):
        index = SearchIndex(spark, f"{place}-{n}", ["x", "y"])
        index.build(rows, versions)
        assert seen[-1].rdd.getNumPartitions() == -(-45 * n * 11 // 100)  # with a marker for each row
        assert index.hits("v", [("a", False)]).count() == 45 and {v: b["n"] for v, b in index.versions().items()} == dict.fromkeys(versions, 45)


def test_index_reads_what_its_terms_can_be_in(spark, place):
    rows = spark.createDataFrame([(i, "v1", " ".join(WORDS)) for i in range(20)], "row long, version string, text string")
    index = SearchIndex(spark, place, ["text"])
    index.build(rows, ["v1"])
    found = index.postings("v1", "th", True)
    scan = plan_of(found)
    assert "PartitionFilters: [" in scan and "lead" in scan.split("PartitionFilters: [")[1].split("]")[0] and "StringStartsWith(token,th)" in scan
    files = {f.split("lead=")[1][0] for f in found.inputFiles()}
    read = index.store.read(["v1"]).where("lead = 't'").inputFiles()
    assert files and len(read) < len(index.store.read(["v1"]).inputFiles()) + 1


def test_index_folds_case_and_diacritics(spark, place):
    """Letters with diacritics are found by the plain ones and the other way round, as marks of their own too."""
    rows = spark.createDataFrame([(1, "v", "Élan vital"), (2, "v", "elan"), (3, "v", "élan"), (4, "v", "elaN"), (5, "v", "elane"), (6, "v", "Ångström ǅ Ệ")], "row long, version string, text string")
    index = SearchIndex(spark, place, ["text"])
    index.build(rows, ["v"])
    hit = lambda q, prefix=False, exact=False: tuples(index.hits("v", [(q, prefix)], exact=exact), "row")
    assert hit("élan") == hit("ELAN") == hit("élan") == [(1,), (2,), (3,), (4,)]
    assert hit("Éla", prefix=True) == [(1,), (2,), (3,), (4,), (5,)]
    assert hit("élan", exact=True) == [(1,)] and hit("angstrom") == [(6,)] and hit("e") == [(6,)]
    words = ["Élan", "naïve", "Ệ", "Straße", "Ωmega", "Łódź", "ø"]
    got = tuples(spark.createDataFrame([(w,) for w in words], "w string").select("w", folded(F.col("w")).alias("f")))
    assert dict(got) == {w: fold(w) for w in words} and fold("Łódź") == "łodz"


def test_index_columns(spark, place):
    """Phrases lie in one column; lengths are those of the columns that are searched."""
    rows = spark.createDataFrame([((0, 1), "v", "a b", "c d"), ((1, 1), "v", "b c", None), ((0, 2), "v", "", "b")], "row struct<kind: int, id: int>, version string, x string, y string")
    index = SearchIndex(spark, place, ["x", "y"], "struct<kind: int, id: int>")
    index.build(rows, ["v"])
    hit = lambda q, cols=None: sorted((tuple(r["row"]), r["dl"]) for r in index.hits("v", [(q, False)], cols).collect())
    assert hit("b c") == [((1, 1), 2)] and hit("b", ["x"]) == [((0, 1), 2), ((1, 1), 2)] and hit("b") == [((0, 1), 4), ((0, 2), 1), ((1, 1), 2)]


# side indexes

def test_side_index(spark, place):
    rows = spark.createDataFrame([(v, ns, f"o{i}", i) for v in ("1", "2") for ns in ("yarn", "mojmap") for i in range(50)], "version_id string, ns string, owner string, n int")
    index = SideIndex(spark, place, "version_id string, ns string, owner string, n int", "owner", buckets=8)
    assert index.build(rows, [("1", "yarn"), ("2", "yarn")]) == [("1", "yarn"), ("2", "yarn")]
    assert index.build(rows, [("1", "yarn"), ("2", "yarn"), ("2", "mojmap")]) == [("2", "mojmap")]  # a second run builds what is new
    found, rest = index.rows(["1", "2", "3"], "yarn", ["o7", "o9", "none"])
    assert rest == ["3"] and tuples(found) == [("1", "yarn", "o7", 7), ("1", "yarn", "o9", 9), ("2", "yarn", "o7", 7), ("2", "yarn", "o9", 9)]
    one, _ = index.rows(["1"], "yarn", ["o7"])
    assert {f.split("bucket=")[1].split("/")[0] for f in one.inputFiles()} and "bucket" in plan_of(one).split("PartitionFilters: [")[1].split("]")[0]
    assert index.rows(["1"], "mojmap")[1] == ["1"] and index.has("2", "mojmap") and pair("1", "yarn") == "1|yarn"


# growing runs

def whole_pass(changes, heads):
    """Runs by replaying every path from its first change."""
    by_path = defaultdict(list)
    for b, p, o, v in sorted(changes, key=str):
        by_path[b, p].append((o, v))
    out = []
    for (b, p), log in by_path.items():
        state, since = None, None
        for o, v in sorted(log, key=lambda x: x[0]):
            if v != state:
                if state is not None:
                    out.append((b, p, state, since, o - 1))
                state, since = v, o
        if state is not None:
            out.append((b, p, state, since, heads[b]))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", range(3))
def test_growing_runs_in_any_split(spark, place, seed):
    rng = random.Random(seed)
    changes, state = [], {}
    for o in range(30):
        for b in ("main", "side"):
            for p in range(12):
                if rng.random() < 0.25:
                    changes.append((b, f"p{p}", o, rng.choice(["x", "y", None])))
    heads = {b: max(o for x, _, o, _ in changes if x == b) for b in ("main", "side")}
    runs, cuts = GrowingRuns(spark, place, buckets=4), sorted(rng.sample(range(1, 30), 3))
    make = lambda rows: spark.createDataFrame(rows, "branch string, path string, ord int, value string")
    for low, high in zip([0, *cuts], [*cuts, 30]):
        batch = [c for c in changes if low <= c[2] < high]
        runs.update(make(batch))
        if seed == 1:
            runs.update(make(batch))  # delivered again
        done = {b: max(o for x, _, o, _ in changes if x == b and o < high) for b in {c[0] for c in changes if c[2] < high}}
        assert tuples(runs.read()) == whole_pass([c for c in changes if c[2] < high], done)
    assert tuples(runs.read()) == whole_pass(changes, heads)
    plain = S.runs(make(changes), ["branch", "path"], "ord", "value", F.when(F.col("branch") == "main", heads["main"]).otherwise(heads["side"]))
    assert tuples(runs.read()) == tuples(plain.select("branch", "path", "value", F.col("from_ord").cast("long").alias("from_ord"), F.col("to_ord").cast("long").alias("to_ord")))


def test_growing_runs_touch_only_their_buckets(spark, place):
    runs = GrowingRuns(spark, place, buckets=16)
    make = lambda rows: spark.createDataFrame(rows, "branch string, path string, ord int, value string")
    assert runs.read().count() == 0
    runs.update(make([("m", f"p{i}", 0, "a") for i in range(100)]))
    runs.update(make([("m", "p3", 1, "b")]))
    assert len(runs._log()[0]["buckets"]) == 16 and len(runs._log()[1]["buckets"]) == 1
    runs.update(make([]), spark.createDataFrame([("m", 5)], "branch string, ord int"))  # versions without a change
    assert {r["to_ord"] for r in runs.read().where("path <> 'p3'").collect()} == {5}
    assert tuples(runs.read().where("path = 'p3'"), "value", "from_ord", "to_ord") == [("a", 0, 0), ("b", 1, 5)]


def test_growing_runs_torn_batch(spark, place, monkeypatch):
    runs = GrowingRuns(spark, place)
    make = lambda rows: spark.createDataFrame(rows, "branch string, path string, ord int, value string")
    runs.update(make([("m", "p", 0, "a")]))
    real = type(spark).createDataFrame
    batch = make([("m", "p", 1, "b")])
    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, *a, **k: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        runs.update(batch)  # the rows are written, the log isn't
    monkeypatch.setattr(type(spark), "createDataFrame", real)
    assert tuples(runs.read()) == [("m", "p", "a", 0, 0)]
    runs.update(batch)
    assert tuples(runs.read()) == [("m", "p", "a", 0, 0), ("m", "p", "b", 1, 1)]


def test_growing_runs_follow_a_stream(spark, place, tmp_path):
    source = str(tmp_path / "changes")
    rows = [("m", f"p{i % 3}", i, "ab"[i % 2]) for i in range(9)]
    make = lambda part: spark.createDataFrame(part, "branch string, path string, ord int, value string")
    runs = GrowingRuns(spark, place)
    for low in (0, 4):
        make(rows[low : low + 4 if low == 0 else 9]).coalesce(1).write.mode("append").parquet(source)
        runs.follow(spark.readStream.schema("branch string, path string, ord int, value string").parquet(source), f"{place}-state")
    assert tuples(runs.read()) == whole_pass(rows, {"m": 8})


def test_changes_of_listings(spark):
    """Full listings become changes, absences and all; the fixture of three versions."""
    files = [("m", 0, "a.txt", "alpha"), ("m", 0, "v.json", "0"), ("m", 1, "a.txt", "alpha"), ("m", 1, "b.txt", "bee"), ("m", 1, "v.json", "1"), ("m", 2, "a.txt", "alpha2"), ("m", 2, "v.json", "2"), ("m", 4, "a.txt", "alpha2")]
    listed = spark.createDataFrame(files, "branch string, ord int, path string, value string")
    versions = spark.createDataFrame([("m", i) for i in (0, 1, 2, 4)], "branch string, ord int")
    got = tuples(changes_of(listed, versions), "path", "ord", "value")
    assert got == sorted([("a.txt", 0, "alpha"), ("a.txt", 2, "alpha2"), ("b.txt", 1, "bee"), ("b.txt", 2, None), ("v.json", 0, "0"), ("v.json", 1, "1"), ("v.json", 2, "2"), ("v.json", 4, None)], key=str)


def test_blob_kinds(spark):
    df = spark.createDataFrame([("assets/lang/en_us.json", "{}"), ("a.txt", "plain"), ("b.png", "x\0y"), ("lang.json", "{}")], "path string, sample string")
    assert dict(tuples(df.select("path", blob_kind(F.col("path"), F.col("sample")).alias("kind")))) == {"assets/lang/en_us.json": "lang", "a.txt": "text", "b.png": "binary", "lang.json": "text"}
