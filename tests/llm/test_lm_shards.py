"""The filter of op5 keeps its bits an item at every size, and knows bigrams seen once."""

from __future__ import annotations

import numpy as np

from verspan.llm import lm_score


def scores(docs):
    out = lm_score.score_texts(docs, docs.where("doc_id % 7 <> 2")).collect()
    return sorted((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 6)) for r in out)


def test_beyond_the_bound_same_scores(spark, monkeypatch):
    r = np.random.default_rng(5)
    rows = [(i, " ".join(f"w{x}" for x in r.zipf(1.3, 60) % 3000)) for i in range(300)] + [(300, None), (301, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = scores(docs)
    monkeypatch.setattr(lm_score, "MAX_BYTES", 64)
    monkeypatch.setattr(lm_score, "SCORE_AT_ONCE", 500)
    assert scores(docs) == want


def test_a_bigram_seen_once_counts(spark):
    docs = spark.createDataFrame([(0, "a b c d e f"), (9, "a b"), (16, "b a")], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in lm_score.score_texts(docs, docs.where("doc_id = 0")).collect()}
    n, v, s = 7, 7, lm_score.SHARE
    seen = lambda c, both: np.log10(s * both + (1 - s) * (c + 1) / (n + v + 1))
    assert abs(got[9] - (seen(1, 1) + seen(1, 1) + seen(1, 0))) < 1e-9
    assert abs(got[16] - (seen(1, 0) + seen(1, 0) + seen(1, 0))) < 1e-9


def test_scores_are_close_to_those_of_exact_counts(spark):
    """Real texts of sf0.01: the model's log probability a token against the same mixture over exact counts; the error comes of quantised counts and false positives."""
    from collections import Counter

    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    train = docs.where(~lm_score.held_out(docs["doc_id"]))
    inside = {r["doc_id"] for r in train.select("doc_id").collect()}
    words = {i: [*(t or "").encode().lower().split(), None] for i, t in rows}
    one, two = Counter(), Counter()
    for i in inside:
        w = words[i]
        one.update(w)
        two.update(zip([None, *w], w))
    n, v, s = sum(one.values()), len(one), lm_score.SHARE
    p = lambda b, x: s * min(two[b, x], one[b]) / max(one[b], 1) + (1 - s) * min((one[x] + 1) / (n + v + 1), 1)
    errors, scores = [], []
    for r in lm_score.score_texts(docs, train).collect():
        w = words[r["doc_id"]]
        want = sum(np.log10(p(b, x)) for b, x in zip([None, *w], w))
        errors.append(abs(r["score"] - want) / len(w))
        scores.append(want / len(w))
    assert np.mean(errors) < 0.03 and max(errors) < 0.25 and -3 < np.mean(scores) < -1
