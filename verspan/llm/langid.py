"""Language identification by cross-parsing entropy.

For each language the suffix automaton of a bounded sample of its labelled text is
built; a text is parsed greedily into the longest phrases that occur in that sample
(each phrase is a longest match, walked along the automaton's transitions). The fewer
phrases a text needs for its letters, the closer its source is to the sample's. A
phrase points into the sample, which takes the logarithm of the sample's length; counts
are normalised by it, as samples can be of unlike length, and the language with the
fewest normalised phrases wins.

Whole texts are parsed, all languages at once: texts are cut into lanes of ``LANE``
symbols that advance together, one array step for each position. Every lane is first
parsed as if a phrase began with it; then the phrase that is open at the end of the lane
before is carried on into it until both parses stand in the same state, from where on
they are one. A phrase may run over any number of lanes. Symbols are lower-case letters
that the samples hold; any run of other characters is one blank.

The sample is the classifier's only bound: of each language the ``sample_docs``
texts first by a hash of their document's id, to ``sample_chars`` symbols together;
null texts and the label ``und`` are no part of it.

Defined cases: a null text or one without a letter is ``und`` with score 0; texts of
letters that no sample holds get the first language in order of name with score
1/languages; with no labelled text all is ``und``; ties go to the first name; extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verspan.llm.common import map_texts, table

#: Bounds of the sample of a language: documents, and symbols of them together.
SAMPLE_DOCS, SAMPLE_CHARS = 40, 20_000
LANE, LANES = 256, 6_000
#: Rounds in which all lanes that disagree are parsed at once, before they are gone through one after the other.
ROUNDS = 4
UND = "und"
_tables: dict = {}


def letters_table() -> np.ndarray:
    """For each code point whether it is a letter."""
    if "letters" not in _tables:
        _tables["letters"] = np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), np.bool_, sys.maxunicode + 1)
    return _tables["letters"]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


class Automata:
    """Suffix automata of all languages in one transition table; symbol 0 is the blank, the last one is unknown."""

    def __init__(self, samples: dict[str, list[str]], most: int):
        self.langs = sorted(samples)
        letters = letters_table()
        clean = {}
        for lang, texts in samples.items():
            c = code_points(" ".join(t.lower() for t in texts))
            c = np.where(letters[c], c, 32)
            clean[lang] = c[np.r_[True, (c[1:] != 32) | (c[:-1] != 32)]][:most] if len(c) else c
        known = np.unique(np.concatenate([c for c in clean.values()])) if clean else np.empty(0, np.uint32)
        known = known[known != 32]
        self.width = len(known) + 2
        self.symbols = np.full(sys.maxunicode + 1, 0, np.int16)
        self.symbols[letters] = self.width - 1
        self.symbols[known] = np.arange(1, len(known) + 1)
        #: Cost of a phrase in each language.
        self.cost = np.log([max(len(clean[x]), 2) for x in self.langs])
        tables, self.roots, shift = [], [], 0
        for lang in self.langs:
            t = self._build(self.symbols[clean[lang]].tolist(), self.width)
            tables.append(np.where(t > 0, t + shift, 0))
            self.roots.append(shift)
            shift += len(t)
        #: Next state for (state, symbol); 0 where there is none. States are numbered over all languages, roots as in self.roots.
        self.next = (np.concatenate(tables) if tables else np.zeros((1, self.width))).astype(np.int32).ravel()

    @staticmethod
    def _build(s: list[int], width: int) -> np.ndarray:
        """Online construction; transitions lead to states over 0, as no suffix automaton leads back to its root."""
        go: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in s:
            cur = len(go)
            go.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in go[p]:
                go[p][c] = cur
                p = link[p]
            if p >= 0:
                q = go[p][c]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    clone = len(go)
                    go.append(dict(go[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and go[p].get(c) == q:
                        go[p][c] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur
        out = np.zeros((len(go), width), np.int32)
        for i, d in enumerate(go):
            out[i, list(d)] = list(d.values())
        return out

    def _step(self, state, root, symbol):
        """(next state, phrases that end) of one symbol."""
        to, again = self.next[state * self.width + symbol], self.next[root * self.width + symbol]
        ends = to == 0
        lost = again == 0  # an unknown symbol is a phrase of its own
        return np.where(ends, np.where(lost, root, again), to), ends * ((state != root) + lost.astype(np.int32))

    def phrases(self, lanes: np.ndarray, begins: np.ndarray, carried: np.ndarray | None = None, over: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Phrases that end in each lane, for each language, and the state at its end; lanes: (lanes, LANE) of symbols, -1 beyond the end.

        begins: whether a lane is the first of its text; only a text's last lane is shorter than LANE. carried: the
        states that texts begin with, if they go on from before; over: whether they end here, so that a phrase that
        is open then counts.

        Each lane is parsed as if a phrase began with it; then from the state that the lane before ends in, until both
        parses agree, which is soon in most texts. Where they don't within ``ROUNDS`` rounds, as in texts that repeat
        themselves, the state is carried through the lanes that still disagree, once from left to right.
        """
        roots = np.array(self.roots, np.int32)
        n, k = len(lanes), len(roots)
        lasts = (lanes >= 0).sum(1)
        order = np.argsort(-lasts, kind="stable")
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        lanes, lasts = np.ascontiguousarray(lanes[order].T), lasts[order]
        # every lane as if a phrase began with it; states and counts after each symbol
        states, counts = np.empty((LANE + 1, n, k), np.int32), np.zeros((LANE + 1, n, k), np.int32)
        states[0] = roots
        for i in range(LANE):
            m = int(np.searchsorted(-lasts, -i))  # lanes that are longer than i
            states[i + 1], counts[i + 1] = states[i], counts[i]
            if m:
                states[i + 1, :m], more = self._step(states[i, :m], roots, lanes[i, :m, None])
                counts[i + 1, :m] += more
        starts = np.repeat(roots[None, :], int(begins.sum()), 0) if carried is None else carried
        total, end = counts[LANE].copy(), np.concatenate([states[LANE], starts])
        before = np.where(begins, n + np.cumsum(begins) - 1, np.r_[0, place[:-1]] if n else place)  # whose end a lane goes on from
        row, col, prior = np.repeat(place, k), np.tile(np.arange(k), n), np.repeat(before, k)
        came = np.repeat(roots[None, :], n, 0)  # the state that each lane was last parsed from
        for _ in range(ROUNDS):
            new = end[prior, col] != came[row, col]
            r, c, s = row[new], col[new], end[prior[new], col[new]]
            if not len(r):
                break
            came[r, c] = s
            total[r, c], end[r, c] = counts[LANE][r, c], states[LANE][r, c]
            own = np.zeros(len(r), np.int32)
            for i in range(LANE):
                on = (s != states[i, r, c]) & (lasts[r] > i)
                met = s == states[i, r, c]
                total[r[met], c[met]] += own[met] - counts[i, r[met], c[met]]
                out = ~met & ~on  # the lane is over
                total[r[out], c[out]], end[r[out], c[out]] = own[out], s[out]
                r, c, s, own = r[on], c[on], s[on], own[on]
                if not len(r):
                    break
                s, more = self._step(s, roots[c], lanes[i, r])
                own = own + more
            met = s == states[LANE, r, c]
            total[r, c] = np.where(met, total[r, c] + own - counts[LANE, r, c], own)
            end[r, c] = s
        self._carried(lanes, lasts, begins, place, before, states, counts, came, total, end)
        total, end = total[place], end[:n][place]
        final = np.r_[begins[1:], True] if n else begins
        if over:
            total[final] += end[final] != roots
        return total, end

    def _carried(self, lanes, lasts, begins, place, before, states, counts, came, total, end) -> None:
        """What is left: lane by lane, each parsed anew once at most; lanes that repeat themselves are looked up."""
        follow, width = memoryview(self.next), self.width
        for c, root in enumerate(self.roots):
            late = np.flatnonzero(end[before, c] != came[place, c])
            known: dict[tuple[bytes, int], tuple[int, int]] = {}
            done = -1
            for first in late.tolist():
                at = first
                while at > done and at < len(place) and (at == first or not begins[at]):
                    r, s = int(place[at]), int(end[before[at], c])
                    if s == came[r, c]:
                        break
                    done, came[r, c] = at, s
                    lane = lanes[: lasts[r], r].tobytes()
                    if (lane, s) not in known:
                        known[lane, s] = self._one(follow, width, int(root), lanes[: lasts[r], r].tolist(), s, states[:, r, c], counts[:, r, c])
                    end[r, c], total[r, c] = known[lane, s]
                    at += 1

    @staticmethod
    def _one(follow, width: int, root: int, symbols: list[int], s: int, states: np.ndarray, counts: np.ndarray) -> tuple[int, int]:
        """(state, phrases) at the end of one lane of one language, parsed from a state."""
        n, plain = 0, states.tolist()
        for i, x in enumerate(symbols):
            if s == plain[i]:
                return plain[-1], n + int(counts[-1] - counts[i])
            to = follow[s * width + x]
            if not to:
                to = follow[root * width + x]
                n += (s != root) + (not to)
                to = to or root
            s = to
        return s, n


def _lanes(sym: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All texts cut into lanes, and the number of lanes of each."""
    each = np.array([-(-len(s) // LANE) for s in sym])
    flat = np.full(int(each.sum()) * LANE, -1, np.int16)
    at = 0
    for s, k in zip(sym, each.tolist()):
        flat[at : at + len(s)] = s
        at += k * LANE
    return flat.reshape(-1, LANE), each


def classify(texts: list[str | None], model: Automata) -> list[tuple[str, float]]:
    """(language, score) of each text; the score is the winner's share of exp(-cost)."""
    letters = letters_table()
    out: list[tuple[str, float]] = [(UND, 0.0)] * len(texts)
    if not model.langs:
        return out
    which, sym, held = [], [], 0

    def done() -> None:
        lanes, each = _lanes(sym)
        first = np.cumsum(each) - each
        begins = np.zeros(len(lanes), np.bool_)
        begins[first] = True
        told(which, np.add.reduceat(model.phrases(lanes, begins)[0], first, axis=0))

    def told(where: list[int], phrases: np.ndarray) -> None:
        cost = phrases * model.cost
        share = 1 / np.exp(cost.min(1, keepdims=True) - cost).sum(1)
        for i, k, p in zip(where, cost.argmin(1).tolist(), share.tolist()):
            out[i] = (model.langs[k], p)

    def by_pieces(s: np.ndarray) -> np.ndarray:
        """Phrases of a text of more lanes than are held at once: its pieces one after the other, the state carried on."""
        total, state, step = 0, None, LANES * LANE
        for at in range(0, len(s), step):
            lanes, each = _lanes([s[at : at + step]])
            begins = np.arange(len(lanes)) == 0
            found, end = model.phrases(lanes, begins, state, at + step >= len(s))
            total, state = total + found.sum(0, dtype=np.int64), end[-1:]
        return total[None, :]

    for i, t in enumerate(texts):
        if not t:
            continue
        c = code_points(t.lower())
        if not letters[c].any():
            continue
        s = model.symbols[c]
        if not ((s > 0) & (s < model.width - 1)).any():
            out[i] = (model.langs[0], 1 / len(model.langs))
            continue
        s = s[np.r_[True, (s[1:] != 0) | (s[:-1] != 0)]]
        if len(s) > LANES * LANE:
            told([i], by_pieces(s))
            continue
        which.append(i)
        sym.append(s)
        held += -(-len(s) // LANE)
        if held >= LANES:
            done()
            which, sym, held = [], [], 0
    if which:
        done()
    return out


def _predict(model_b, text_col: str, kept: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_b.value
        for b in batches:
            found = classify(b.column(text_col).to_pylist(), model)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], [*kept, "lang_pred", "score"])
    return run


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> Automata:
    """Automata of a bounded sample: of each language the first texts by a hash of their document's id."""
    rows = labelled.select(labelled[lang_col].alias("lang"), labelled[text_col].alias("text"), F.xxhash64(labelled[id_col].cast("string")).alias("h"))
    rows = rows.where(f"lang is not null and lang <> '{UND}' and text is not null")
    r = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    chosen = rows.select("lang", "h").distinct().withColumn("r", r).where(F.col("r") <= sample_docs)  # narrow rows, limited in each task before the shuffle
    first = rows.join(F.broadcast(chosen), ["lang", "h"]).select("lang", "r", F.substring("text", 1, sample_chars).alias("text"))
    # an id can have any number of rows: of them, too, each task keeps the first ones only
    first = first.withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy("r", "text"))).where(F.col("at") <= sample_docs)
    samples: dict[str, list[str]] = {}
    for r in first.orderBy("lang", "at").collect():  # at most sample_docs of each language
        samples.setdefault(r["lang"], []).append(r["text"])
    return Automata(samples, sample_chars)


def identify(docs: DataFrame, model: Automata, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(id, lang_pred, score) of each document, or the columns in ``keep`` with these two; columns of their names give way."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in keep or [id_col] if c not in ("lang_pred", "score")]
    rows = docs.select(*dict.fromkeys([*kept, text_col]))
    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return map_texts(rows, _predict(sent, text_col, kept), schema)


def held_out(id_col: Column, of: int = 4) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % of == 2, F.lit(False))


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out(docs["doc_id"])))
    return identify(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
