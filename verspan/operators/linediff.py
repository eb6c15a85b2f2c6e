"""Line differences, unified patches, function slices and blame.

Lists of lines in Arrow batches: one text pair is one row. The greedy shortest edit
script (Myers) is used within a budget of its trace; beyond it the middle between the
common beginning and end is aligned by a longest common subsequence of any size.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verspan.shared import stored

#: Numbers of a trace, as the reference bounds it: its rounds are this by 2 (n + m) + 1.
TRACE = 16_000_000


def split_lines(text: str | None) -> list[str]:
    """Lines with CRLF and CR as LF, without an empty last one; none of a null or empty text."""
    if not text:
        return []
    out = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    return out[:-1] if out[-1] == "" else out


def _myers(x: list[str], y: list[str], rounds: int) -> list[tuple[str, int, int]] | None:
    """Greedy shortest edit script; null if it takes more edits than ``rounds``."""
    n, m = len(x), len(y)
    off = min(n + m, rounds) + 1
    v, trace = [0] * (2 * off + 1), []
    for d in range(off):
        trace.append(array("q", v[off - d - 1 : off + d + 2]))
        for k in range(-d, d + 1, 2):
            i = v[off + k + 1] if k == -d or k != d and v[off + k - 1] < v[off + k + 1] else v[off + k - 1] + 1
            j = i - k
            while i < n and j < m and x[i] == y[j]:
                i, j = i + 1, j + 1
            v[off + k] = i
            if i >= n and j >= m:
                break
        else:
            continue
        break
    else:
        return None
    out, i, j = [], n, m
    for d in range(len(trace) - 1, 0, -1):
        w, k = trace[d], i - j
        at = k + d + 1
        before = k + 1 if k == -d or k != d and w[at - 1] < w[at + 1] else k - 1
        pi = w[before + d + 1]
        pj = pi - before
        while i > pi and j > pj:
            i, j = i - 1, j - 1
            out.append((" ", i, j))
        out.append(("+", i, pj) if i == pi else ("-", pi, j))
        i, j = pi, pj
    while i > 0 and j > 0:
        i, j = i - 1, j - 1
        out.append((" ", i, j))
    return out[::-1]


def _common(x: list[str], y: list[str]) -> list[tuple[str, int, int]]:
    """Edit script by a longest common subsequence, removals first where both ways are as long.

    Lengths are of suffixes. Every ``step``-th row is held and the rows between are made
    again as the script passes them, so memory grows with the root of the rows only.
    """
    n, m, ids = len(x), len(y), {}
    a = np.array([ids.setdefault(s, len(ids)) for s in x], np.int64)
    b = np.array([ids.setdefault(s, len(ids)) for s in y], np.int64)
    back = b[::-1]

    def above(row: np.ndarray, i: int) -> np.ndarray:
        """Row i from row i + 1; place t is of the last t lines of y."""
        out = row.copy()
        np.maximum(out[1:], row[:-1] + (back == a[i]), out=out[1:])
        return np.maximum.accumulate(out, out=out)

    step = math.isqrt(n) + 1
    held, row = {n: np.zeros(m + 1, np.int32)}, np.zeros(m + 1, np.int32)
    for i in range(n - 1, -1, -1):
        row = above(row, i)
        if i % step == 0:
            held[i] = row
    out, j = [], 0
    for lo in range(0, n, step):
        hi = min(lo + step, n)
        own = {hi: held[hi]}
        for i in range(hi - 1, lo - 1, -1):
            own[i] = above(own[i + 1], i)
        i = lo
        while i < hi and j < m:
            if a[i] == b[j]:
                out.append((" ", i, j))
                i, j = i + 1, j + 1
            elif own[i + 1][m - j] >= own[i][m - j - 1]:
                out.append(("-", i, j))
                i += 1
            else:
                out.append(("+", i, j))
                j += 1
        out += [("-", k, j) for k in range(i, hi)]
    return out + [("+", n, k) for k in range(j, m)]


def edits(a: list[str], b: list[str], key=lambda s: s) -> list[tuple[str, int, int]]:
    """Edit script: (' ', i, j) same, ('-', i, j) removed, ('+', i, j) added; i, j count from 0."""
    x, y = [key(s) for s in a], [key(s) for s in b]
    lo = 0
    while lo < min(len(x), len(y)) and x[lo] == y[lo]:
        lo += 1
    end = 0
    while end < min(len(x), len(y)) - lo and x[-1 - end] == y[-1 - end]:
        end += 1
    n, m = len(x) - lo - end, len(y) - lo - end
    own, other = x[lo : lo + n], y[lo : lo + m]
    mid = _myers(own, other, TRACE // (2 * (len(x) + len(y)) + 1))
    if mid is None:
        mid = _common(own, other)
    head = [(" ", i, i) for i in range(lo)]
    return head + [(t, lo + i, lo + j) for t, i, j in mid] + [(" ", lo + n + i, lo + m + i) for i in range(end)]


def patch(path: str, old: str | None, new: str | None, context: int = 3, ignore_space: bool = False) -> str:
    """Unified patch of one file; empty without a change; null stands for no file."""
    context = max(0, min(20, context))
    a, b = split_lines(old), split_lines(new)
    key = (lambda s: re.sub(r"\s+", " ", s.strip())) if ignore_space else (lambda s: s)
    script = edits(a, b, key)
    changes = [k for k, e in enumerate(script) if e[0] != " "]
    if not changes:
        return ""
    hunks: list[list[int]] = []
    for k in changes:
        s, e = max(0, k - context), min(len(script), k + context + 1)
        if hunks and s <= hunks[-1][1]:
            hunks[-1][1] = e
        else:
            hunks.append([s, e])
    out = [f"diff --git a/{path} b/{path}"]
    if old is None:
        out.append("new file mode 100644")
    if new is None:
        out.append("deleted file mode 100644")
    out += ["--- /dev/null" if old is None else f"--- a/{path}", "+++ /dev/null" if new is None else f"+++ b/{path}"]

    def place(s: int, e: int, side: int, mark: str) -> str:
        own = [x[side] + 1 for x in script[s:e] if x[0] in (" ", mark)]
        start = own[0] if own else next((x[side] + 1 for x in reversed(script[:s]) if x[0] in (" ", mark)), 0)
        return f"{start}" if len(own) == 1 else f"{start},{len(own)}"

    for s, e in hunks:
        out.append(f"@@ -{place(s, e, 1, '-')} +{place(s, e, 2, '+')} @@")
        out += [t + (a[i] if t == "-" else b[j]) for t, i, j in script[s:e]]
    return "\n".join(out)


def function_slice(text: str | None, name: str) -> str | None:
    """Lines of a function: annotations before it, to the end of its braces; null if there is none."""
    own = split_lines(text)
    call = re.compile(rf"\b{re.escape(re.split(r'[#/.]', name)[-1])}\s*\(")
    at = next((i for i, x in enumerate(own) if call.search(x) and not x.strip().startswith("//")), None)
    if at is None:
        return None
    start = at
    while start and own[start - 1].strip().startswith("@"):
        start -= 1
    depth, opened = 0, False
    for end in range(at, len(own)):
        for c in own[end]:
            if c == "{":
                depth, opened = depth + 1, True
            elif c == "}":
                depth -= 1
        if opened and depth <= 0:
            return "\n".join(own[start : end + 1])
    return "\n".join(own[start:])


def blame(texts: list[tuple[object, str | None]]) -> list[tuple[str, object]]:
    """(line, version) of the last text: for each line the version that brought it; texts in order."""
    held: list[tuple[str, object]] = []
    for version, text in texts:
        new = split_lines(text)
        script = edits([x for x, _ in held], new)
        held = [(new[j], version) if t == "+" else held[i] for t, i, j in script if t != "-"]
    return held


def patch_column(path: Column, old: Column, new: Column, context: int = 3, ignore_space: bool = False) -> Column:
    @F.pandas_udf("string")
    def run(p: pd.Series, o: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([patch(x, y, z, context, ignore_space) for x, y, z in zip(p, o, n)])

    return run(path, old, new)


def slice_column(text: Column, name: str) -> Column:
    @F.pandas_udf("string")
    def run(t: pd.Series) -> pd.Series:
        return t.map(lambda x: function_slice(x, name))

    return run(text)


_SEGMENT = "path string, first long, text string, last string, origin array<int>, version array<long>"
_ENTERED = "path string, place int, last string, origin array<int>, version array<long>"


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Folds the sorted versions of each path that a task has: first and last text, and for each last line the first text's line that it is, or the version that brought it."""
    names = [f.split()[0] for f in _SEGMENT.split(", ")]
    held: dict | None = None

    def out(h: dict) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int64()))
        row = (h["path"], h["first"], h["text"], h["last"], [i for i, _ in h["lines"]], [v for _, v in h["lines"]])
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds)], names)

    for b in batches:
        for path, version, text in zip(*(b.column(c).to_pylist() for c in ("path", "version", "text"))):
            new = split_lines(text)
            if held is None or held["path"] != path:
                if held is not None:
                    yield out(held)
                held = {"path": path, "first": version, "text": text, "lines": [(i, None) for i in range(len(new))]}
            else:
                held["lines"] = [(-1, version) if t == "+" else held["lines"][i] for t, i, _ in edits(held["split"], new) if t != "-"]
            held["last"], held["split"] = text, new
    if held is not None:
        yield out(held)


def _entered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Origins in the segment's first text become origins in the last text of the segment before; its new lines get the segment's first version."""
    names = [f.split()[0] for f in _ENTERED.split(", ")]
    for b in batches:
        origins, versions = [], []
        for before, text, first, origin, version in zip(*(b.column(c).to_pylist() for c in ("before", "text", "first", "origin", "version"))):
            old = [None if t == "+" else i for t, i, _ in edits(split_lines(before), split_lines(text)) if t != "-"]
            back = [old[i] if i >= 0 else None for i in origin]
            origins.append([-1 if x is None else x for x in back])
            versions.append([(first if i >= 0 else v) if x is None else None for i, x, v in zip(origin, back, version)])
        yield pa.RecordBatch.from_arrays([b.column("path"), b.column("place"), b.column("last"), pa.array(origins, pa.list_(pa.int32())), pa.array(versions, pa.list_(pa.int64()))], names)


def _followed(segments: pa.Table) -> pa.Table:
    """The segments of a path in order, as numbers only: a line's version is its own, or that of the line it was before."""
    rows = sorted(segments.to_pylist(), key=lambda r: r["place"])
    held: list = []
    for r in rows:
        held = [held[i] if i >= 0 else v for i, v in zip(r["origin"], r["version"])]
    lines = split_lines(rows[-1]["last"])
    columns = [[rows[0]["path"]] * len(lines), range(1, len(lines) + 1), lines, held]
    return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.int64()))], ["path", "line_no", "line", "version"])


def blame_lines(texts: DataFrame, path: str, version: str, text: str) -> DataFrame:
    """(path, line_no, line, version) of each path's last text: the version that brought each line.

    Rows are dealt out by ranges of path and version, so that a path with very many versions
    is spread over tasks; a task folds its versions one after the other and holds two texts.
    What a task found of a path is a map from the lines of its first text to those of its
    last; maps of segments that follow each other are joined at their ends and composed,
    at most one for each task, as arrays of numbers. Versions in order, a null one last;
    a null text has no lines.
    """
    order = [F.col("path"), F.asc_nulls_last("version")]
    rows = texts.select(F.col(path).cast("string").alias("path"), F.col(version).cast("long").alias("version"), F.col(text).alias("text"))
    segments = rows.repartitionByRange(*order).sortWithinPartitions(*order, "text").mapInArrow(_segments, _SEGMENT)
    segments = stored(segments.withColumn("task", F.spark_partition_id()), "segments")
    w = Window.partitionBy("path").orderBy(F.asc_nulls_last("first"), "task")
    placed = segments.withColumn("place", F.row_number().over(w)).withColumn("before", F.lag("last").over(w)).withColumn("latest", F.lead("task").over(w).isNull())
    # of all but the latest segment only numbers go on
    entered = placed.select("path", "first", "before", "text", F.when(F.col("latest"), F.col("last")).alias("last"), "origin", "version", "place")
    return entered.mapInArrow(_entered, _ENTERED).groupBy("path").applyInArrow(_followed, "path string, line_no long, line string, version long")
