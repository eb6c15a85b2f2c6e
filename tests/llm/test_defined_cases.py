"""Empty tables, ties, nulls, clashing columns and very long texts of the operators that had no test of them."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from verspan.llm import chat, html_extract, line_dedup, lm_score

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert lm_score.score_texts(docs, docs).count() == 0
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert chat.format_chat(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    one = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    got = lm_score.score_texts(one, docs).first()  # nothing learned
    assert got["n_known"] == 0 and got["train_tokens"] == 0 and got["n_tokens"] == 3


def test_chat_ties_nulls_and_clashing_columns(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "assistant", "z"), (1, None, "system", "first"), (1, 1, None, None), (None, 0, "user", "alone"), (1, 0, "user", "a")]
    df = spark.createDataFrame([(*r, "f", "h", 9) for r in rows], "conv_id long, turn long, role string, text string, formatted string, head string, found int")
    turns = {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in chat.format_chat(df).withColumn("turns", chat.read_turns(F.col("formatted"))).collect()}
    assert turns == {1: [("system", "first"), ("assistant", "z"), ("user", "a"), ("user", "a"), ("user", "b"), ("unknown", "")], None: [("user", "alone")]}


def test_extraction_with_clashing_columns(spark):
    df = spark.createDataFrame([(1, "u", "<article><p>One text, of some length; it goes on.</p></article>", "t", 5), (None, None, None, "t", 5)], "page_id long, url string, html string, text string, n_chars int")
    assert sorted(map(tuple, html_extract.extract(df).collect()), key=str) == sorted([(1, "u", "One text, of some length; it goes on.", 37), (None, None, "", 0)], key=str)


def test_very_long_texts(spark):
    text = "\n".join(f"a line of its own, number {i}, that is long enough" for i in range(40_000))
    docs = spark.createDataFrame([(i, text if i < 2 else "short") for i in range(4)], "doc_id long, text string")
    kept = {r["doc_id"]: r["kept_text"] for r in line_dedup.dedup_lines(docs).collect()}
    assert kept[0] == text and kept[2] == "short"  # fewer documents than the bound share the lines
    scored = {r["doc_id"]: r for r in lm_score.score_texts(docs, docs).collect()}
    assert scored[0]["n_tokens"] == len(text.split()) + 1 == scored[0]["n_known"] and scored[0]["score"] == scored[1]["score"]
    rows = [(1, i, "assistant" if i % 2 else "user", "x <y> & z " * 2000) for i in range(60)]
    r = chat.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).withColumn("loss", chat.read_loss(F.col("formatted"), F.col("loss_spans"))).first()
    assert r["loss"] == "x <y> & z " * 2000 * 30


@pytest.mark.parametrize("columns", [DOCS, DOCS + ", id long, h string, component_id int, line string, row int"])
def test_pipeline_stages_on_empty_documents(spark, columns):
    import corpus_pipeline as c

    docs = spark.createDataFrame([], columns)
    for name, stage in c.STAGES[:-1]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.columns == docs.columns and out.count() == 0, name
    assert c.STAGES[-1][1](spark, docs, "/root/testdata/sf0.001").count() == 0


def test_pipeline_stages_with_clashing_columns(spark):
    """Extra columns come through, whatever they are called; a null id and a null text are defined."""
    import corpus_pipeline as c

    base = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    docs = base.union(spark.createDataFrame([(None, "a text without an id, of a few words", "en", "s", 5), (7, None, "en", "s", None)], base.schema))
    docs = docs.withColumns({"id": F.lit(1), "h": F.lit("h"), "line": F.lit("l"), "component_id": F.lit(2), "lang_pred": F.lit("x"), "row": F.lit(3)})
    plain = docs.select(base.columns)
    for name, stage in c.STAGES[:-1]:
        got, want = stage(spark, docs, "/root/testdata/sf0.001"), stage(spark, plain, "/root/testdata/sf0.001")
        assert got.columns == docs.columns, name
        assert sorted(map(str, got.select(base.columns).collect())) == sorted(map(str, want.collect())), name
        docs, plain = got, want
