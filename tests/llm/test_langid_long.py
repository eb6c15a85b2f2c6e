"""Cross parsing of long texts that repeat themselves: linear, and equal to a parse symbol by symbol."""

from __future__ import annotations

import random
import time

import numpy as np

from verspan.llm import langid



def plain(model, symbols):
    """Phrases by one step after the other for each language."""
    out = []
    for root in model.roots:
        s, n = int(root), 0
        for x in symbols:
            to = int(model.next[s * model.width + x])
            if not to:
                again = int(model.next[root * model.width + x])
                n += (s != root) + (again == 0)
                to = again or int(root)
            s = to
        out.append(n + (s != root))
    return out


def test_phrases_of_repetitive_texts(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = langid.fit(docs)
    symbols = lambda t: (lambda s: s[np.r_[True, (s[1:] != 0) | (s[:-1] != 0)]])(model.symbols[langid.code_points(t.lower())])
    rng = random.Random(1)
    texts = ["abc def ghi " * 3000, "ababab" * 2000, "the " * 5000, "e" * 9000, "xyz" * 700 + "the and of " * 900, "".join(rng.choices("abc de", k=20_000)), "short", "ab " * 1000 + "ä" * 3000]
    for rounds in (4, 0, 1):
        monkeypatch.setattr(langid, "ROUNDS", rounds)
        sym = [symbols(t) for t in texts]
        lanes, each = langid._lanes(sym)
        first = np.cumsum(each) - each
        begins = np.zeros(len(lanes), np.bool_)
        begins[first] = True
        got = np.add.reduceat(model.phrases(lanes, begins)[0], first, axis=0).tolist()
        assert got == [plain(model, s.tolist()) for s in sym]
    monkeypatch.undo()
    want = langid.classify(texts, model)
    monkeypatch.setattr(langid, "LANES", 7)  # longer texts go by pieces
    assert [x for x, _ in langid.classify(texts, model)] == [x for x, _ in want]
    assert np.allclose([p for _, p in langid.classify(texts, model)], [p for _, p in want])


def test_long_periodic_text_is_linear(spark):
    model = langid.fit(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    for unit in ("abc def ghi ", "the of and in it ", "x"):
        began = time.time()
        langid.classify([unit * (3_000_000 // len(unit))], model)
        assert time.time() - began < 20
