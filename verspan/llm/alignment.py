"""Cross-tokenizer alignment: minimal groups of overlapping tokens, and how often ids are linked.

Both tokenizers write the same bytes, a blank and the text. A token of A and a token of B
are linked where their byte ranges overlap; union-find over these links gives connected
components, which are the smallest groups that both cut the text into; each component's
members give back its links. A pair of ids counts the documents that hold it linked.

A text is cut before each blank that stands between a character that is no blank and one
that is no white space. Neither tokenizer has a token across such a place (A's pattern
begins a piece there; B has no piece with a blank inside, which is checked), so no group
reaches over it: a part is encoded and aligned once, and a bounded cache gives what
repeated parts gave. Long texts are taken in windows that end at such places.

Counting is distributed: a document's distinct pairs are stored with it; tasks pre-count
pairs before they are shuffled. Frequent pairs, at most ``MAX_HOT`` by a histogram of
counts, are broadcast to the documents; the links of all rarer pairs meet their counts in
a shuffle, in which no pair is frequent. Both ways add up, at any size.

Defined cases: a null or empty text, and one whose joined bytes under A or B are not those
of a blank and the text, has no tokens: zeros and an empty digest; special tokens' strings
are plain text; documents that share an id are rows each and count each; a null id stays
null; of pairs of one A id that share the highest count all are best; extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verspan.llm.common import map_texts, packed, scratch, stored, table, unpacked

A, B = "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"
#: Bytes of parts that a worker's cache holds; characters of a window; documents encoded at once. Only speed and memory depend on them.
CACHE_BYTES, WINDOW, AT_ONCE = 64 << 20, 1 << 20, 200
#: Pairs that are broadcast at most (16 bytes each); pairs that a task counts before it sends them on.
MAX_HOT, FLUSH = 1 << 20, 1 << 20
BLANK = "▁"
_CUT = re.compile(r"(?<=[^ ]) (?=\S)")
DOCS = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, codes binary, times binary"
OUT = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, codes array<long>, times array<long>"
#: A pair is A's id in the high bits and B's in the low ones.
_SHIFT = 32


def paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(A), public_tokenizers.path(B)


class Tokenizers:
    """Ids of both tokenizers and the bytes that each id stands for. A: ranks of a byte-level BPE with the vocabulary's own ids; B: a piece model."""

    def __init__(self, a_path: str, b_path: str):
        import public_tokenizers
        import sentencepiece
        import tiktoken

        with open(a_path, "rb") as lines:
            ranks = {base64.b64decode(token): int(i) for token, i in map(bytes.split, lines)}
        self._a = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.a_bytes[i] = token
        pieces = [self._b.id_to_piece(i) for i in range(self._b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:-1], 16)]) if self._b.is_byte(i) else p.replace(BLANK, " ").encode() for i, p in enumerate(pieces)]
        if any(BLANK in p.lstrip(BLANK) for i, p in enumerate(pieces) if not self._b.is_control(i)):
            raise ValueError("a piece holds a blank after another character: texts can't be cut at blanks")
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in t]) for t in (self.a_bytes, self.b_bytes))
        # an id as it is written, with what can follow it
        self.a_written, self.b_written = (np.array([[b"%d%s" % (i, c) for c in (b",", end)] for i in range(len(t))], object) for t, end in ((self.a_bytes, b"|"), (self.b_bytes, b";")))

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of a blank and the text by A and by B; None if either's bytes differ."""
        a, b, whole = self._a.encode_ordinary(" " + text), self._b.encode(text), b" " + text.encode()
        if b"".join(map(self.a_bytes.__getitem__, a)) != whole or b"".join(map(self.b_bytes.__getitem__, b)) != whole:
            return None
        return np.array(a, np.int64), np.array(b, np.int64)


def links(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the tokens of both sides whose byte ranges overlap, in order.

    Between two ends that follow each other, whichever side they are of, lies one token of either side, and each
    overlap is one such range.
    """
    ends = np.union1d(a_ends, b_ends)
    return np.searchsorted(a_ends, ends), np.searchsorted(b_ends, ends)


def components(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Union-find over edges (u, v) of n nodes, all at once: the smallest node of each node's connected component.

    Roots hook to the smallest root that an edge leads to, then paths are halved until every node points to its root;
    chains at least halve with each round.
    """
    parent = np.arange(n)
    while True:
        pu, pv = parent[u], parent[v]
        apart = pu != pv
        if not apart.any():
            return parent
        u, v, pu, pv = u[apart], v[apart], pu[apart], pv[apart]
        np.minimum.at(parent, np.maximum(pu, pv), np.minimum(pu, pv))
        while (parent != (up := parent[parent])).any():
            parent = up


class Aligner:
    """Parts and what they give: sizes packed into one integer, written groups, codes of linked pairs; null if the bytes differ."""

    def __init__(self, tokenizers: Tokenizers):
        self.tok, self.young, self.old, self.held = tokenizers, {}, {}, 0

    def _aligned(self, parts: list[str]) -> Iterator[tuple[int, bytes, bytes] | None]:
        """Of parts that a cut would tell apart, as one text."""
        ids = self.tok.encode(" ".join(parts))
        if ids is None:
            yield from ([None] if len(parts) == 1 else (one for p in parts for one in self._aligned([p])))
            return
        a, b = ids
        a_ends, b_ends = np.cumsum(self.tok.a_sizes[a]), np.cumsum(self.tok.b_sizes[b])
        i, j = links(a_ends, b_ends)
        root = components(len(a) + len(b), i, len(a) + j)
        # tokens by component, those of A first: the order in which they are written
        order = np.argsort(root, kind="stable")
        of_a, group = order < len(a), root[order]
        last = np.append((group[1:] != group[:-1]) | (of_a[1:] != of_a[:-1]), True).astype(np.intp)
        written = np.empty(len(order), object)
        written[of_a] = self.tok.a_written[a[order[of_a]], last[of_a]]
        written[~of_a] = self.tok.b_written[b[order[~of_a] - len(a)], last[~of_a]]
        written, codes = written.tolist(), a[i] << _SHIFT | b[j]
        ends = np.cumsum([len(p.encode()) + 1 for p in parts])
        to_a, to_b = np.searchsorted(a_ends, ends) + 1, np.searchsorted(b_ends, ends) + 1
        to_link = np.searchsorted(a_ends[i], ends, side="right")
        to_group = np.append(0, np.cumsum(root[i][1:] != root[i][:-1]))[to_link - 1] + 1
        cuts = np.stack([to_a, to_b, to_group, to_link]).T.tolist()
        n_a = n_b = n_g = n_l = 0
        for x, y, g, k in cuts:
            yield x - n_a | y - n_b << 40 | g - n_g << 80, b"".join(written[n_a + n_b : x + y])[:-1], codes[n_l:k].tobytes()
            n_a, n_b, n_g, n_l = x, y, g, k

    def learn(self, parts: set[str]) -> None:
        """Afterwards ``young`` holds all these parts; beyond the bound it starts anew, and the last generation stays at hand."""
        if self.held > CACHE_BYTES:
            self.old, self.young, self.held = self.young, {}, 0
        need = parts - self.young.keys()
        for p in need & self.old.keys():
            self._keep(p, self.old[p])
        need -= self.young.keys()
        plain = [p for p in need if p and p[-1] != " " and not p[0].isspace() and BLANK not in p]
        for p, found in zip(plain, self._aligned(plain) if plain else ()):
            self._keep(p, found)
        for p in need.difference(plain):
            self._keep(p, next(self._aligned([p])))

    def _keep(self, part: str, found: tuple[int, bytes, bytes] | None) -> None:
        self.young[part] = found
        self.held += 300 + 2 * len(part) + (len(found[1]) + len(found[2]) if found else 0)

    def windows(self, text: str) -> Iterator[str]:
        at = 0
        while len(text) - at > WINDOW and (m := _CUT.search(text, at + WINDOW)):
            yield text[at : m.start()]
            at = m.end()
        yield text[at:]

    def texts(self, texts: list[str | None]) -> Iterator[tuple[int, int, int, int, str, np.ndarray, np.ndarray]]:
        """(tokens of A, of B, groups, links, digest, distinct codes, times) of each text."""
        small = [_CUT.split(t) if t and len(t) <= WINDOW else () for t in texts]
        self.learn(set().union(*small))
        found = [list(map(self.young.__getitem__, s)) for s in small]  # before what follows may start the cache anew
        for own, t in zip(found, texts):
            yield self._gathered([own] if own else self._of_windows(t) if t else [])

    def _of_windows(self, text: str) -> Iterator[list]:
        for w in self.windows(text):
            parts = _CUT.split(w)
            self.learn(set(parts))
            yield list(map(self.young.__getitem__, parts))

    @staticmethod
    def _gathered(windows: Iterable[list]) -> tuple:
        digest, sizes, n, codes, times = hashlib.sha256(), 0, 0, [], []
        for k, found in enumerate(windows):
            if None in found:
                sizes = 0
                break
            own_sizes, written, own_codes = zip(*found)
            digest.update(b";" * (k > 0) + b";".join(written))
            sizes += sum(own_sizes)
            own = np.frombuffer(b"".join(own_codes), np.int64)
            n += len(own)
            c, m = np.unique(own, return_counts=True)
            codes.append(c)
            times.append(m)
        if not sizes:
            return 0, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(codes) > 1:
            all_codes, where = np.unique(np.concatenate(codes), return_inverse=True)
            codes, times = [all_codes], [np.bincount(where, np.concatenate(times)).astype(np.int64)]
        low = (1 << 40) - 1
        return sizes & low, sizes >> 40 & low, sizes >> 80, n, digest.hexdigest(), codes[0], times[0]


_aligner: dict[tuple[str, str], Aligner] = {}


def _documents(a_path: str, b_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (a_path, b_path) not in _aligner:
            _aligner[a_path, b_path] = Aligner(Tokenizers(a_path, b_path))
        aligner = _aligner[a_path, b_path]
        for b in batches:
            for s in range(0, b.num_rows, AT_ONCE):
                own = b.slice(s, AT_ONCE)
                cols = list(zip(*aligner.texts(own.column("text").to_pylist())))
                codes = [packed(c.view(np.uint64)) for c in cols[5]]
                times = [m.astype("<u4").tobytes() for m in cols[6]]
                yield pa.RecordBatch.from_arrays([own.column("row"), own.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.string()), pa.array(codes, pa.binary()), pa.array(times, pa.binary())], [f.partition(" ")[0] for f in DOCS.split(", ")])
    return run


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(code, n): in how many documents of some in a row a pair is linked."""
    def sums(held: list[np.ndarray]) -> pa.RecordBatch:
        codes, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(codes), pa.array(n)], ["code", "n"])

    held, size = [], 0
    for b in batches:
        for c in b.column("codes"):
            held.append(unpacked(c.as_py()).view(np.int64))
            size += len(held[-1])
            if size > FLUSH:
                yield sums(held)
                held, size = [], 0
    if size:
        yield sums(held)


def _looked_up(sent):
    """A document's links by the frequent pairs' counts; ``codes`` and ``times`` are left with the others."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n, best = sent.value
        for b in batches:
            rows, sums, best_sums, rest, rest_times, offsets = b.num_rows, [], [], [], [], [0]
            for c, m in zip(b.column("codes").to_pylist(), b.column("times").to_pylist()):
                codes, times = unpacked(c).view(np.int64), np.frombuffer(m, "<u4").astype(np.int64)
                at = np.minimum(np.searchsorted(known, codes), max(len(known) - 1, 0))
                hit = known[at] == codes if len(known) else np.zeros(len(codes), bool)
                sums.append(int((n[at[hit]] * times[hit]).sum()))
                best_sums.append(int(times[hit][best[at[hit]]].sum()))
                rest.append(codes[~hit])
                rest_times.append(times[~hit])
                offsets.append(offsets[-1] + len(rest[-1]))
            lists = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(x) if x else np.zeros(0, np.int64))) for x in (rest, rest_times)]
            own = [b.column(c) for c in ("row", "doc_id", "n_a", "n_b", "n_groups", "n_links")]
            if rows:
                yield pa.RecordBatch.from_arrays([*own, pa.array(best_sums, pa.int64()), pa.array(sums, pa.int64()), b.column("groups_sha256"), *lists], [f.partition(" ")[0] for f in OUT.split(", ")])
    return run


def pair_counts(docs: DataFrame) -> DataFrame:
    """(code, n, best): documents that hold a pair linked; whether no pair of its A id has more. docs: with ``codes``."""
    n = docs.select("codes").mapInArrow(_counted, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).withColumn("a", F.shiftright("code", _SHIFT))
    top = n.groupBy("a").agg(F.max("n").alias("top"))  # a row for each id of A's vocabulary
    return n.join(top, "a").select("code", "n", (F.col("n") == F.col("top")).alias("best"))


def _least_hot(counts: DataFrame, most: int) -> int:
    """The smallest power of two so that at most ``most`` pairs count as much."""
    sizes = {r["b"]: r["count"] for r in counts.groupBy(F.floor(F.log2("n")).cast("int").alias("b")).count().collect()}  # at most 64 rows
    total, least = 0, max(sizes, default=0) + 1
    for b in sorted(sizes, reverse=True):
        total += sizes[b]
        if total > most:
            break
        least = b
    return 1 << least


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", most: int = MAX_HOT) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each document."""
    spark = docs.sparkSession
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    with scratch(spark) as keep:
        own = keep(map_texts(texts, _documents(a_path, b_path), DOCS), "documents")
        counts = keep(pair_counts(own), "counts")
        least = _least_hot(counts, most)
        hot = counts.where(F.col("n") >= least).toArrow()  # at most ``most`` rows
        code = hot["code"].to_numpy()
        order = np.argsort(code)
        sent = spark.sparkContext.broadcast((code[order], hot["n"].to_numpy()[order], hot["best"].to_numpy()[order]))
        found = map_texts(own, _looked_up(sent), OUT)
        if least > 1:
            found = keep(found, "found")
            each = found.select("row", F.explode(F.arrays_zip("codes", "times")).alias("x")).select("row", F.col("x.codes").alias("code"), F.col("x.times").alias("t"))
            rest = each.join(counts.where(F.col("n") < least), "code").groupBy("row").agg(F.sum(F.col("t") * F.col("n")).alias("s"), F.sum(F.when(F.col("best"), F.col("t")).otherwise(0)).alias("k"))
            found = found.join(rest, "row", "left").withColumn("n_best", F.col("n_best") + F.coalesce("k", F.lit(0))).withColumn("count_sum", F.col("count_sum") + F.coalesce("s", F.lit(0)))
        out = found.select(F.col("doc_id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
        return stored(out, "aligned")


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"), *paths())
