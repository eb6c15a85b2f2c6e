"""Operators on hand-sized cases and by invariants."""

from __future__ import annotations

import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from verspan.functions import text as T
from verspan.operators import correspondence as C
from verspan.operators import diff as D
from verspan.operators import graph as G
from verspan.operators import linediff as L
from verspan.operators import spans as S
from verspan.sources.classfile import ClassFile, read_declarations, read_references, simple_class, subtypes
from verspan.sources.tiny import parse_tiny


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def test_diff_null_keys_and_symmetry(spark):
    a = spark.createDataFrame([("a", "x"), ("b", "y"), (None, "n")], "k string, name string")
    b = spark.createDataFrame([("b", "z"), ("c", "w"), (None, "n")], "k string, name string")
    ab, ba = D.diff_by_key(a, b, ["k"], "name"), D.diff_by_key(b, a, ["k"], "name")
    assert rows(ab, "bucket", "k") == sorted([("added", "c"), ("added", None), ("removed", "a"), ("removed", None), ("renamed", "b")], key=str)
    assert rows(ab.where("bucket = 'added'"), "k") == rows(ba.where("bucket = 'removed'"), "k")


def test_package_filter_and_synthetic(spark):
    df = spark.createDataFrame([("Net/a/B",), ("net/ab/C",), (None,)], "n string")
    assert df.where(D.in_package(F.col("n"), "net/a")).count() == 1
    s = spark.createDataFrame([("A#lambda$m$0",), ("A#m",), (None,)], "n string")
    assert rows(s.where(D.not_synthetic(F.col("n"))), "n") == [("A#m",), (None,)]


def test_collapse_spans_partition_the_range(spark):
    df = spark.createDataFrame([("e", v, s) for v, s in enumerate(["a", "a", None, None, "a"])], "k string, v long, s string")
    assert rows(S.collapse(df, ["k"], "v", ["s"]), "from_v", "to_v", "s", "versions") == [(0, 1, "a", 2), (2, 3, None, 2), (4, 4, "a", 1)]


def test_runs_of_a_change_log(spark):
    log = [("a", 0, "alpha"), ("a", 2, "alpha2"), ("b", 1, "bee"), ("b", 2, None)]
    df = spark.createDataFrame(log, "path string, ord long, blob string")
    r = S.runs(df, ["path"], "ord", "blob", F.lit(2).cast("long"))
    assert rows(r, "path", "blob", "from_ord", "to_ord") == [("a", "alpha", 0, 1), ("a", "alpha2", 2, 2), ("b", "bee", 1, 1)]
    assert rows(S.interval_diff(r, ["path"], "blob", 0, 1), "path", "change") == [("b", "added")]


def test_directory(spark):
    df = spark.createDataFrame([("x/a/b.txt",), ("x/c.txt",), ("y/d",)], "path string")
    assert rows(S.directory(df, "x"), "name", "is_dir") == [("a", True), ("c.txt", False)]


def test_correspondence_presence(spark):
    y = spark.createDataFrame([("a", "Y")], "k string, n string")
    m = spark.createDataFrame([("a", "M"), ("b", "M2")], "k string, n string")
    i = spark.createDataFrame([("c", "I")], "k string, n string")
    out = C.outer_join([("yarn", y), ("intermediary", i), ("mojmap", m)], "k").withColumn("p", C.presence(F.col("yarn"), F.col("intermediary"), F.col("mojmap")))
    assert rows(out, "k", "p") == [("a", "both"), ("b", "mojmap_only"), ("c", "yarn_only")]


def test_null_safe_join_and_first_wins(spark):
    a = spark.createDataFrame([("o", None, 1), ("o", None, 2)], "owner string, d string, a int")
    b = spark.createDataFrame([("o", None, 5)], "owner string, d string, b int")
    one = C.first_wins(a, ["owner", "d"], ["a"])
    assert rows(C.null_safe_join(one, b, ["owner"], ["d"]), "owner", "d", "a", "b") == [("o", None, 1, 5)]


def test_hierarchy_and_chains(spark):
    e = spark.createDataFrame([("A", "B"), ("I", "B"), ("B", "C"), ("B", "D"), ("D", "B")], "parent string, child string")
    root = spark.createDataFrame([("B",)], "root string")
    assert rows(G.closure(e, root, "parent", "child"), "node", "depth") == [("B", 0), ("C", 1), ("D", 1)]
    c = G.call_chains(e, root, "child", "parent", 3)
    assert ("A",) in rows(c, "chain") and any(x[0].startswith("B > D") for x in rows(c, "chain"))


def test_semver_order(spark):
    v = ["1.9", "1.10-alpha.5", "1.10-pre.1", "1.10-pre.1.1", "1.10-pre.2", "1.10-pre.10", "1.10", "1.10+x", "weird"]
    df = spark.createDataFrame([(x,) for x in v], "v string").withColumn("s", T.semver(F.col("v"))).orderBy(F.asc_nulls_last("s"), "v")
    assert [r["v"] for r in df.collect()] == v


def test_descriptors(spark):
    df = spark.createDataFrame([("(ILa;[Lb;J)La;",), ("(Lfoo",), ("LLevel;",)], "d string").withColumn("m", F.create_map(F.lit("a"), F.lit("net/A")))
    assert [r[0] for r in df.select(T.map_types(F.col("d"), F.col("m"))).collect()] == ["(ILnet/A;[Lb;J)Lnet/A;", "(Lfoo", "LLevel;"]


def test_names(spark):
    df = spark.createDataFrame([("a/b/C$D",)], "n string")
    assert df.select(T.simple_name(F.col("n")), T.package_path(F.col("n")), T.outer_class(F.col("n"))).first()[:] == ("D", "a/b", "a/b/C")
    lam = spark.createDataFrame([("lambda$new$0",), ("lambda$run$12",), ("m",), ("method_12",)], "n string")
    assert [r[0] for r in lam.select(T.lambda_owner(F.col("n"))).collect()] == ["<init>", "run", "m", "method_12"]
    assert [r[0] for r in lam.select(T.real_name(F.col("n"))).collect()][-1] is None


line = st.sampled_from(["a", "b", "c", "  a", ""])


@settings(max_examples=200, deadline=None)
@given(st.lists(line, max_size=12), st.lists(line, max_size=12))
def test_edits_rebuild_both_sides(a, b):
    script = L.edits(a, b)
    assert [a[i] for t, i, _ in script if t != "+"] == a
    assert [b[j] for t, _, j in script if t != "-"] == b
    assert all(a[i] == b[j] for t, i, j in script if t == " ")


def test_patch_format():
    p = L.patch("f.java", "a\nb\nc\n", "a\nx\nc\n", 1)
    assert p == "diff --git a/f.java b/f.java\n--- a/f.java\n+++ b/f.java\n@@ -1,3 +1,3 @@\n a\n-b\n+x\n c"
    assert L.patch("f", "a\n  b", "a\nb", ignore_space=True) == ""
    assert "new file mode 100644\n--- /dev/null\n+++ b/f\n@@ -0,0 +1 @@\n+a" in L.patch("f", None, "a")
    assert L.patch("f", None, None) == "" == L.patch("f", "a", "a")


def test_function_slice_and_blame():
    code = "class A {\n  // run(\n  @X\n  void run() {\n    if (a) { b(); }\n  }\n  void other() {}\n}"
    assert L.function_slice(code, "p/A#run") == "  @X\n  void run() {\n    if (a) { b(); }\n  }"
    assert L.function_slice(code, "none") is None and L.function_slice(None, "x") is None
    assert L.blame([(1, "a\nb"), (2, "a\nx\nb"), (3, "a\nx\nc")]) == [("a", 1), ("x", 2), ("c", 3)]


def test_class_files(spark):
    a = simple_class("p/A", "java/lang/Object", [("x", "I")], [("run", "()V"), ("lambda$run$0", "()V")], [("p/B", "foo", "()V"), ("p/B", "foo", "()V"), ("java/X", "y", "()V")])
    b = simple_class("p/B", "p/A", [], [("foo", "()V")])
    files = spark.createDataFrame(pd.DataFrame({"content": [a, b]}), "content binary")
    d = read_declarations(files)
    assert rows(d.select("owner", F.get("supertypes", F.lit(0)).alias("s")), "owner", "s") == [("p/A", "java/lang/Object"), ("p/B", "p/A")]
    assert rows(subtypes(d), "parent", "subtypes") == [("p/A", ["p/B"])]
    r = read_references(files).groupBy("ref_owner", "ref_member", "ref_synthetic", "owner", "member").count()
    method = [("p/A", "run", s, "p/B", m, 2) for s in ("lambda$run$0", None) for m in ("foo", None)]
    assert rows(r, "ref_owner", "ref_member", "ref_synthetic", "owner", "member", "count") == sorted([*method, ("p/B", None, None, "p/A", None, 1)], key=str)
    c = ClassFile(a)


def test_method_references_hide_in_bootstraps():
    """A lambda's handle is a call of the method that makes it; another bootstrap's is none."""
    make = lambda **k: ClassFile(simple_class("p/A", "p/P", [], [("run", "()V"), ("run", "(I)V"), ("lambda$run$0", "()V"), ("lambda$new$1", "()V")], **k))
    c = make(handles=[("p/B", "bar", "()V"), ("p/A", "run", "()V")])
    assert [r[2:] for r in c.refs if r[0] == "lambda$run$0"] == [("p/B", "bar", "()V", "call"), ("p/B", None, None, "call"), ("p/A", "run", "()V", "call")]
    assert c.refs[0] == (None, None, "p/P", None, None, "class")
    assert c.fold("lambda$run$0", "()V") == ("run", None, "lambda$run$0") and c.fold("lambda$new$1", "()V") == ("lambda$new$1", "()V", None)
    assert make(handles=[("p/B", "bar", "()V")], factory="java/lang/runtime/ObjectMethods").refs == c.refs[:1]


def test_tiny_both_versions(spark):
    two = "tiny\t2\t0\tofficial\tintermediary\tnamed\nc\tdnv\tn/class_1\tn/Block\n\tm\t()Ldpb;\tn\tmethod_1\tgetState\n\t\tp\t1\t\t\tx\n\tf\tLgs;\tj\tfield_1\t\n"
    one = "v1\tofficial\tintermediary\nCLASS\ta\tn/class_2\nMETHOD\ta\t()V\tb\tmethod_100\nFIELD\ta\t[F\tc\tfield_5\n"
    df = parse_tiny(spark.createDataFrame([("2", two), ("1", one)], "path string, value string"))
    assert rows(df.select("path", "kind", "owner", "descriptor", F.col("names")["official"].alias("o"), F.col("names")["named"].alias("n")), "path", "kind", "owner", "descriptor", "o", "n") == sorted([
        ("2", "class", "dnv", None, "dnv", "n/Block"), ("2", "method", "dnv", "()Ldpb;", "n", "getState"), ("2", "field", "dnv", "Lgs;", "j", None),
        ("1", "class", "a", None, "a", None), ("1", "method", "a", "()V", "b", None), ("1", "field", "a", "[F", "c", None)], key=str)


def test_stream_replaces_partitions(spark, tmp_path):
    from verspan.streaming.ingest import missing, run_stream

    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(1, "a"), (2, "b")], "v int, x string").write.parquet(src)
    stream = lambda: spark.readStream.schema("v int, x string").parquet(src)
    run_stream(stream(), out, str(tmp_path / "state"), "v")
    spark.createDataFrame([(2, "c")], "v int, x string").write.mode("append").parquet(src)
    run_stream(stream(), out, str(tmp_path / "state"), "v")
    assert rows(spark.read.parquet(out), "v", "x") == [(1, "a"), (2, "c")]
    assert rows(missing(spark.createDataFrame([(2,), (3,)], "v int"), spark.read.parquet(out), "v"), "v") == [(3,)]


def test_closure_of_any_depth(spark):
    """A chain of 70 and a cycle; each node once, nearest first."""
    e = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(70)] + [("n70", "n60"), ("n0", "n5"), (None, "n1")], "a string, b string")
    got = dict(rows(G.closure(e, spark.createDataFrame([("n0",)], "r string"), "a", "b"), "node", "depth"))
    assert got == {f"n{i}": i if i < 5 else i - 4 for i in range(71) if i < 5 or i >= 5} | {f"n{i}": i for i in range(1, 4)} | {"n4": 4}


def _labels_case(code, **k):
    return ClassFile(simple_class("p/A", "p/P", [], [("run", "()V")], code=code, **k)).bodies["run", "()V"]


def test_bodies_do_not_depend_on_places():
    """A wide constant pool makes ldc into ldc_w and shifts jumps and the padding of switches; the body stays the same."""
    import struct

    def code(case=0, shift=0):
        def made(constant):
            i = constant("text")
            ldc = struct.pack(">BB", 18, i) if i < 256 else struct.pack(">BH", 19, i)
            head = b"\x00" * shift + ldc + b"\x57\x1b"  # ldc, pop, iload_1
            pad = b"\x00" * ((-(len(head) + 1)) % 4)
            size = 1 + len(pad) + 12 + 8
            ends = [size, size + 1, size + 2]  # three returns
            switch = b"\xaa" + pad + struct.pack(">iii", ends[2], 0, 1) + struct.pack(">ii", ends[case], ends[1])
            return head + switch + b"\xb1\xb1\xb1"
        return made

    one = _labels_case(code())
    assert one == _labels_case(code(), before=[f"x{i}" for i in range(300)])
    assert one != _labels_case(code(case=1)) and one.split("\n")[:3] == ['18 "text"', "87", "21 1"]
    assert _labels_case(code(shift=1)).split("\n")[1:] == one.split("\n")  # but for the instruction that shifts it


def test_bodies_name_jumps_handlers_and_spellings():
    loop = lambda far: lambda constant: b"\x1a\x99\x00\x09" + (b"\xc8\x00\x00\x00\x07" if far else b"\x00\x00\xa7\x00\x05") + b"\x00\x00\xb1"
    near, far = (_labels_case(loop(f)).split("\n") for f in (False, True))
    assert [x for x in near if x != "0"] == [x for x in far if x != "0"] and near[0] == "21 0" and near[1] == "153 L0"
    body = _labels_case(lambda c: b"\x00\xb1\xbf", tries=[(0, 1, 2, "java/lang/Throwable")])
    assert body == "try L0 L1 L2 {java/lang/Throwable}\nL0\n0\nL1\n177\nL2\n191"
    assert _labels_case(lambda c: b"\x1d\xb1") == _labels_case(lambda c: b"\x15\x03\xb1") == _labels_case(lambda c: b"\xc4\x15\x00\x03\xb1")  # iload 3
    assert _labels_case(lambda c: b"\x84\x01\xff\xb1") == _labels_case(lambda c: b"\xc4\x84\x00\x01\xff\xff\xb1") == "132 1 -1\n177"
    lookup = _labels_case(lambda c: b"\x03\xab\x00\x00" + b"\x00\x00\x00\x13" + b"\x00\x00\x00\x01" + b"\x00\x00\x00\x05" + b"\x00\x00\x00\x14" + b"\xb1\xb1")
    assert lookup == "3\n171 5 L0 L1\nL1\n177\nL0\n177"


def test_lambda_targets_are_part_of_a_body():
    make = lambda *h: ClassFile(simple_class("p/A", "p/P", [], [("run", "()V")], handles=list(h))).bodies["run", "()V"]
    assert make(("p/B", "x", "()V")) != make(("p/B", "y", "()V"))
    assert make(("p/B", "x", "(Lp/C;)V")).startswith("186 run (){java/lang/Runnable} {java/lang/invoke/LambdaMetafactory} metafactory ()V {p/B} x ({p/C})V")
