"""Best-fit packing with exact-complement hashing.

Documents are tokenised where they lie; only piece lengths matter for the packing, so
the plan is made over the histogram of lengths (at most ``capacity`` entries whatever
the input): starting from the longest pieces, the gap is filled by a single length, a
pair or a triple that fills it exactly and is still available; where there is none,
the longest available piece that fits goes in (best fit) and the search starts anew. A
combination is used as often as its lengths are available at once. Pieces then find
their place by their rank among the pieces of their length: rank in the task, plus
what earlier tasks have of the length. No group of equal lengths is ever brought
together.

Tokenising: text is cut before each space or line feed that stands between two characters
which are no white space, or, where white space meets white space, before each space that
a non-space follows; there the tokenizer's own pattern always begins a new piece; a part's ids are looked up in a
cache of the worker and else asked of the tokenizer, all new ones of a few texts at once,
so that repeated words are tokenised once; the worker keeps the parts of two generations, so that frequent ones
stay. A text that holds one of the tokenizer's added tokens goes to the tokenizer whole.
The ids are those of the whole text.

Defined cases: a null or empty text is the end id alone; longer documents are cut
into pieces of ``capacity`` with the shorter piece first; documents that share an id
are packed each; a null id stays null; extra columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Collection, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verspan.llm.common import CACHES, map_texts, stored, table

CAPACITY, END_ID = 2048, 0
TOKENIZER = "byte_bpe_50k.json"
#: Parts of a generation whose ids a worker keeps, their characters and bytes of ids, and documents tokenised at once; only speed depends on them.
PART_CACHE, PART_BYTES, AT_ONCE = 500_000, 48 << 20, 400
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, local_rank long"

_CUT = re.compile(r" (?=\S)")
_state: dict = {}
CACHES[__name__] = _state.clear


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def tokenizer(path: str):
    if _state.get("path") != path:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        added = [re.escape(t.content) for t in tok.get_added_tokens_decoder().values()]
        bytes_of = np.zeros(tok.get_vocab_size(), np.int64)
        for token, i in tok.get_vocab().items():
            bytes_of[i] = len(token)  # a token is written with one character for each byte
        _state.update(path=path, tok=tok, bytes_of=bytes_of, added=re.compile("|".join(added)) if added else None, young={}, old={}, held=0)
    return _state["tok"]


def ids_of(docs: list[str | None], path: str) -> list[bytes]:
    """Token ids of each text as little-endian unsigned 32-bit integers."""
    tok = tokenizer(path)
    young, old, added = _state["young"], _state["old"], _state["added"]
    encode = getattr(tok, "encode_batch_fast", tok.encode_batch)

    def asked(parts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in encode(parts, add_special_tokens=False)]

    def asked_at_once(parts: list[str]) -> list[bytes]:
        """As one text; their ids are told apart by the bytes that tokens stand for."""
        ids = np.array(encode(["".join(parts)], add_special_tokens=False)[0].ids, "<u4")
        ends = np.cumsum([len(p.encode()) for p in parts])
        cuts = (4 * np.searchsorted(np.cumsum(_state["bytes_of"][ids]), ends, side="left") + 4).tolist()
        whole = ids.tobytes()
        return [whole[a:b] for a, b in zip([0, *cuts], cuts)]

    def keep(keys: Collection[str], ids: Collection[bytes]) -> None:
        young.update(zip(keys, ids))
        _state["held"] += sum(map(len, keys)) + sum(map(len, ids))

    def learned(keys: list[str], parts: list[str]) -> None:
        if parts:
            keep(keys, asked_at_once(parts))

    # the first part has nothing before it; others are keyed without their blank, or by their line feed
    cut = [[""] if not t else [t] if "\0" in t or added and added.search(t) else t.replace("\n", " \n").split(" ") for t in docs]
    tails = [c[1:] for c in cut]
    need = set().union(*tails).difference(young)
    odd = {p for p in need if not p or p[-1].isspace() or p[0].isspace() and (p[0] != "\n" or p[1].isspace())}  # white space that meets other white space
    again = False
    for i, c in enumerate(tails):
        if c and (cut[i][0][-1:].isspace() or odd and not odd.isdisjoint(c)):
            cut[i] = _CUT.split(docs[i])
            tails[i] = ["\0" + p for p in cut[i][1:]]  # parts with white space in them have keys of their own
            again = True
    if again:
        need = set().union(*tails).difference(young)
    known = need & old.keys()
    keep(known, [old[p] for p in known])
    need -= known
    lines, rough = [p for p in need if p[0] == "\n"], [p for p in need if p[0] == "\0"] if again else []
    plain = list(need.difference(lines, rough))
    learned(rough, [" " + p[1:] for p in rough])
    learned(lines, lines)
    learned(plain, [" " + p for p in plain])
    out = [h + b"".join(map(young.__getitem__, c)) for h, c in zip(asked([c[0] for c in cut]), tails)]
    if len(young) > PART_CACHE or _state["held"] > PART_BYTES:
        _state.update(young={}, old=young, held=0)
    return out


def _pieces(path: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, part = [0] * (capacity + 1), TaskContext.get().partitionId()
        end = np.array([end_id], "<u4").tobytes()
        for b in batches:
            for s in range(0, b.num_rows, AT_ONCE):
                own = b.slice(s, AT_ONCE)
                rows = []
                for i, ids in zip(own.column("id").to_pylist(), ids_of(own.column("text").to_pylist(), path)):
                    ids += end
                    n = len(ids) // 4
                    at = 0
                    for piece in range(-(-n // capacity)):
                        to = at + (n - at - 1) % capacity + 1
                        rows.append((i, piece, at, to - at, zlib.crc32(ids[4 * at : 4 * to]), part, ranks[to - at]))
                        ranks[to - at] += 1
                        at = to
                cols = list(zip(*rows))
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["doc_id", "piece", "start", "length", "ids_crc32", "part", "local_rank"])
    return run


def complement(free: np.ndarray, gap: int) -> list[int] | None:
    """One, two or three available lengths that fill the gap exactly; free[l]: how many of length l."""
    if free[gap]:
        return [gap]

    def pair(g: int, cut: int) -> list[int] | None:
        x = np.arange(min(g - 1, cut), (g - 1) // 2, -1)
        ok = (free[x] > 0) & (free[g - x] > (x == g - x))
        return [int(y := x[np.argmax(ok)]), int(g - y)] if len(x) and ok.any() else None

    if found := pair(gap, gap):
        return found
    for x in np.flatnonzero(free[:gap])[::-1].tolist():
        if 3 * x < gap:
            break
        free[x] -= 1
        found = pair(gap - x, x)
        free[x] += 1
        if found:
            return [x, *found]
    return None


def plan(counts: np.ndarray, capacity: int) -> list[tuple[list[int], int]]:
    """Combinations of lengths and how often each is used; counts[l]: pieces of length l."""
    left, out = counts.copy(), []
    for longest in range(capacity, 0, -1):
        while left[longest]:
            free, chosen, gap = left.copy(), [longest], capacity - longest
            free[longest] -= 1
            while gap:
                more = complement(free, gap)
                if more is None:
                    fits = np.flatnonzero(free[: gap + 1])
                    if not len(fits):
                        break
                    more = [int(fits[-1])]
                chosen += more
                for x in more:
                    free[x] -= 1
                gap -= sum(more)
            lengths, each = np.unique(chosen, return_counts=True)
            times = int((left[lengths] // each).min())
            left[lengths] -= each * times
            out.append((chosen, times))
    return out


def _slots(combos: list[tuple[list[int], int]], capacity: int) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: first rank of each allocation, its first sequence, its offset."""
    used, rows, sequence = [0] * (capacity + 1), {}, 0
    for chosen, times in combos:
        at = 0
        for x in chosen:
            rows.setdefault(x, []).append((used[x], sequence, at))
            used[x] += times
            at += x
        sequence += times
    return {x: tuple(np.array(c, np.int64) for c in zip(*r)) for x, r in rows.items()}


def _placed(slots_b):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = slots_b.value
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            seq, off = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for x in np.unique(length):
                own = np.flatnonzero(length == x)
                first, sequence, at = slots[int(x)]
                i = np.searchsorted(first, rank[own], side="right") - 1
                seq[own], off[own] = sequence[i] + rank[own] - first[i], at[i]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(seq), pa.array(off)],
                                             ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])
    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row for each piece with its place in a sequence."""
    spark = docs.sparkSession
    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    pieces = stored(map_texts(rows, _pieces(path or tokenizer_path(), capacity, end_id), PIECES), "pieces")
    by_part = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = by_part.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")).drop("n")
    counts = np.zeros(capacity + 1, np.int64)
    for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most capacity rows
        counts[r["length"]] = r["n"]
    slots_b = spark.sparkContext.broadcast(_slots(plan(counts, capacity), capacity))
    ranked = pieces.join(before, ["part", "length"]).withColumn("rank", F.col("local_rank") + F.col("before"))
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(_placed(slots_b), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
