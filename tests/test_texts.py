"""Patches and blame of whole tables and whole texts against brute force."""

from __future__ import annotations

import random
import re

import pandas as pd
import pytest

from verspan.operators import linediff as L
from verspan.plans.queries import QUERIES


def versions(seed: int, count: int) -> list[list[str]]:
    """Texts of unique lines that are only inserted and deleted, so that there is one shortest script."""
    r, made, out = random.Random(seed), 0, []
    own: list[str] = []
    for _ in range(count):
        own = [x for x in own if r.random() > 0.1]
        for _ in range(r.choice([2, 30, 120])):
            own.insert(r.randint(0, len(own)), f"line {made} of {seed} " + "x" * r.randint(0, 60))
            made += 1
        out.append(list(own))
    return out


def body(patch: str) -> list[str]:
    """The lines of a patch from its first hunk."""
    own = patch.split("\n")
    return own[next((k for k, x in enumerate(own) if x.startswith("@@")), len(own)) :]


def applied(old: list[str], patch: str) -> list[str]:
    """The new lines by the hunks of a patch."""
    out, at = [], 0
    for x in body(patch):
        m = re.fullmatch(r"@@ -(\d+)(?:,(\d+))? \+\d+(?:,\d+)? @@", x)
        if m:
            start = int(m[1]) - (m[2] != "0")
            out, at = out + old[at:start], start
        elif x[0] == "+":
            out.append(x[1:])
        else:
            assert old[at] == x[1:]
            out, at = out + [x[1:]] * (x[0] == " "), at + 1
    return out + old[at:]


@pytest.fixture(scope="module")
def texts(spark, tmp_path_factory):
    made = {(f"s{s}", "en"): versions(s, 8) for s in range(3)}
    docs = [(10 * v + s, f"s{s}", "en", "\n".join(made[f"s{s}", "en"][v])) for s in range(3) for v in range(8)]
    lengths = [None if i == 30 else len(t) for i, _, _, t in docs]
    assert sum(x is None or x >= 4000 for x in lengths) > 5
    path = str(tmp_path_factory.mktemp("texts"))
    d = pd.DataFrame({"doc_id": [x[0] for x in docs], "source": [x[1] for x in docs], "lang": [x[2] for x in docs], "text": [x[3] for x in docs], "n_chars": pd.array(lengths, "Int64")})
    spark.createDataFrame(d.astype({"n_chars": object}).where(d.notna(), None), "doc_id long, source string, lang string, text string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return path, made


def test_line_diff_patch_whole(spark, texts):
    path, made = texts
    got = {r["doc_id"]: r["patch"] for r in QUERIES["line_diff_patch"](spark, path).collect()}
    assert len(got) == 24
    for (source, _), own in made.items():
        for v, new in enumerate(own):
            old, p = own[v - 1] if v else [], got[10 * v + int(source[1:])]
            assert applied(old, p) == new
            assert sorted(x for x in body(p) if x[0] in "+-") == sorted([f"-{x}" for x in set(old) - set(new)] + [f"+{x}" for x in set(new) - set(old)])


def test_blame_lines_whole(spark, texts):
    path, made = texts
    want: dict[tuple[str, int], int] = {}
    for (source, lang), own in made.items():
        for x in own[-1]:
            first = next(v for v in range(8) if all(x in t for t in own[v:]))
            k = (f"{source}/{lang}", 10 * first + int(source[1:]))
            want[k] = want.get(k, 0) + 1
    assert {(r["path"], r["version"]): r["lines"] for r in QUERIES["blame_lines"](spark, path).collect()} == want


def by_table(x, y):
    """The reference's alignment over the full table of suffix lengths."""
    n, m = len(x), len(y)
    dp = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            dp[i][j] = dp[i + 1][j + 1] + 1 if x[i] == y[j] else max(dp[i + 1][j], dp[i][j + 1])
    out, i, j = [], 0, 0
    while i < n and j < m:
        if x[i] == y[j]:
            out, i, j = [*out, (" ", i, j)], i + 1, j + 1
        elif dp[i + 1][j] >= dp[i][j + 1]:
            out, i = [*out, ("-", i, j)], i + 1
        else:
            out, j = [*out, ("+", i, j)], j + 1
    return out + [("-", k, j) for k in range(i, n)] + [("+", n, k) for k in range(j, m)]


def test_script_beyond_the_trace_equals_the_table(monkeypatch):
    monkeypatch.setattr(L, "TRACE", 0)
    r = random.Random(3)
    for _ in range(300):
        a, b = (["<", *(r.choice("abcd") for _ in range(r.randint(1, 20))), ">"] for _ in range(2))
        lo = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        end = next((k for k, (x, y) in enumerate(zip(a[lo:][::-1], b[lo:][::-1])) if x != y), min(len(a), len(b)) - lo)
        script = L.edits(a, b)
        assert script[lo : len(script) - end] == [(t, lo + i, lo + j) for t, i, j in by_table(a[lo : len(a) - end], b[lo : len(b) - end])]


@pytest.mark.parametrize("lines", [3000, 7000])
def test_more_than_2000_edits(lines):
    """3000 lines: beyond the trace; 7000: also beyond 40,000,000 cells."""
    a = [f"line {i}" for i in range(lines)]
    b = [x if i % 3 else f"new {i}" for i, x in enumerate(a)]
    script = L.edits(a, b)
    assert sum(t != " " for t, _, _ in script) == 2 * -(-lines // 3) >= 2000
    assert [a[i] for t, i, _ in script if t != "+"] == a and [b[j] for t, _, j in script if t != "-"] == b
    held = L.blame([(1, "\n".join(a)), (2, "\n".join(b))])
    assert held == [(x, 1 if i % 3 else 2) for i, x in enumerate(b)]


def test_blame_of_a_long_history_over_many_tasks(spark):
    """One path holds nearly all versions; ranges of them are folded apart and composed."""
    rng, text, rows = random.Random(12), [f"line {i}" for i in range(30)], []
    for v in range(3000):
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(text) + 1)
            text[at : at + rng.randrange(2)] = [rng.choice(["same", "other", f"new {v}"])] * rng.randrange(3)
        rows.append(("hot", v, "\n".join(text) if v % 500 else None if v else "\n".join(text)))
    rows += [("one", 7, "a\nb"), ("gone", 1, "x"), ("gone", 2, None), (None, 1, "p"), (None, 2, "p\nq"), ("late", None, "z\ny"), ("late", 3, "y")]
    by_path = {}
    for p, v, t in rows:
        by_path.setdefault(p, []).append((v, t))
    want = sorted((str(p), n + 1, x, v) for p, vs in by_path.items() for n, (x, v) in enumerate(L.blame(sorted(vs, key=lambda r: (r[0] is None, r[0] or 0)))))
    df = spark.createDataFrame(rows, "p string, v long, t string").repartition(3)
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "13")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = [(str(r["path"]), r["line_no"], r["line"], None if r["version"] is None else int(r["version"])) for r in L.blame_lines(df, "p", "v", "t").collect()]
    finally:
        for k, x in old.items():
            spark.conf.set(k, x)
    assert sorted(got, key=str) == sorted(want, key=str)
