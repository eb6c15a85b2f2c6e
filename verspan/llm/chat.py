"""Chat formatting by DataFrame functions only.

A message is a list of typed content parts. ``part_text`` visits a part: text is
escaped, and an image, audio or document part becomes a placeholder ``<|image:0|>``
numbered in order within its conversation's message, while its reference and the
tokens it expands to are recorded. A turn is
``<|turn|>role<|says|>content<|end|>`` and a line feed. In roles and texts ``&`` and
``<`` are written ``&amp;`` and ``&lt;``, so that ``<`` only ever begins a control
string and the escape can be undone.

A conversation's turns are first put together in blocks of ``BLOCK`` turns, then the
blocks are joined: no task holds a long conversation as single turns. Offsets come
from the lengths of blocks and turns.

Defined cases: a null text is empty, a null role is ``unknown``; turns that tie are
ordered by role and text, null turns come first; repeated rows are repeated turns;
null conv_id is a conversation of its own; an empty table gives no rows; columns
other than the named ones are not used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verspan.llm.common import table

BLOCK = 64
TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>\n"
PARTS = T.ArrayType(T.StructType([T.StructField("type", T.StringType()), T.StructField("text", T.StringType()), T.StructField("ref", T.StringType()), T.StructField("units", T.LongType())]))
#: Tokens that one unit (image tile, second of audio, page) expands to.
UNIT_TOKENS = {"image": 256, "audio": 25, "document": 512}


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def is_attachment(p: Column) -> Column:
    return p["type"].isin(*UNIT_TOKENS)


def part_text(p: Column, place: Column) -> Column:
    """The visitor: an attachment's placeholder, else the escaped text; unknown types count as text."""
    return F.when(is_attachment(p), F.concat(F.lit("<|"), p["type"], F.lit(":"), place.cast("string"), F.lit("|>"))).otherwise(escape(F.coalesce(p["text"], F.lit(""))))


def part_tokens(p: Column) -> Column:
    tokens = F.lit(0).cast("long")
    for kind, n in UNIT_TOKENS.items():
        tokens = F.when(p["type"] == kind, F.coalesce(p["units"], F.lit(1)) * n).otherwise(tokens)
    return tokens


def flatten_parts(parts: Column) -> tuple[Column, Column, Column]:
    """(content, attachments, expanded tokens) of one message; a null list is empty."""
    parts = F.coalesce(parts, F.array().cast(PARTS))
    place = lambda i: F.size(F.filter(F.slice(parts, 1, i), is_attachment))
    content = F.array_join(F.transform(parts, lambda p, i: part_text(p, place(i))), "")
    found = F.transform(F.filter(parts, is_attachment), lambda p, i: F.struct(p["type"].alias("type"), p["ref"].alias("ref"), i.cast("long").alias("place"), part_tokens(p).alias("tokens")))
    tokens = F.aggregate(parts, F.lit(0).cast("long"), lambda a, p: a + part_tokens(p))
    return content, found, tokens


def format_chat(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str | None = "text", parts_col: str | None = None, loss_role: str = "assistant") -> DataFrame:
    """One row for each conversation: formatted, loss_spans (code points), attachments, expanded_tokens."""
    parts = messages[parts_col].cast(PARTS) if parts_col else F.array(F.struct(F.lit("text").alias("type"), messages[text_col].alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("long").alias("units"))).cast(PARTS)
    content, found, tokens = flatten_parts(parts)
    role = F.coalesce(messages[role_col], F.lit("unknown"))
    head = F.concat(F.lit(TURN), escape(role), F.lit(SAYS))
    turns = messages.select(messages[conv_col].alias("conv"), messages[turn_col].cast("long").alias("turn"), role.alias("role"), head.alias("head"), content.alias("content"), found.alias("found"), tokens.alias("tokens"))
    turns = turns.withColumn("block", F.floor(F.col("turn") / BLOCK))
    item = F.struct("turn", "role", "content", "head", "found", "tokens")
    blocks = turns.groupBy("conv", "block").agg(F.array_sort(F.collect_list(item)).alias("ts"))
    shown = F.transform("ts", lambda t: F.concat(t["head"], t["content"], F.lit(END)))
    #: Offset of each turn in its block: lengths before it.
    offsets = F.aggregate("ts", F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans")),
                          lambda a, t: F.struct((a["at"] + F.char_length(t["head"]) + F.char_length(t["content"]) + len(END)).alias("at"),
                                                F.when(t["role"] == loss_role, F.concat(a["spans"], F.array(F.struct((a["at"] + F.char_length(t["head"])).alias("start"), F.char_length(t["content"]).cast("long").alias("length"))))).otherwise(a["spans"]).alias("spans")))
    blocks = blocks.select("conv", "block", F.array_join(shown, "").alias("text"), offsets.alias("o"), F.size("ts").cast("long").alias("n"),
                           F.flatten(F.transform("ts", lambda t, i: F.transform(t["found"], lambda x: F.struct(i.cast("long").alias("turn_in_block"), x["type"].alias("type"), x["ref"].alias("ref"), x["place"].alias("place"), x["tokens"].alias("tokens"))))).alias("found"),
                           F.aggregate("ts", F.lit(0).cast("long"), lambda a, t: a + t["tokens"]).alias("tokens"))
    convs = blocks.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("block", "text", "o", "n", "found", "tokens"))).alias("bs"))
    spans = F.aggregate("bs", F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<array<struct<start:bigint,length:bigint>>>").alias("all")),
                        lambda a, b: F.struct((a["at"] + b["o"]["at"]).alias("at"), F.concat(a["all"], F.array(F.transform(b["o"]["spans"], lambda s: F.struct((s["start"] + a["at"]).alias("start"), s["length"].alias("length"))))).alias("all")),
                        lambda a: F.flatten(a["all"]))
    return convs.select(F.col("conv").alias(conv_col), F.array_join(F.transform("bs", lambda b: b["text"]), "").alias("formatted"), spans.alias("loss_spans"),
                        F.flatten(F.transform("bs", lambda b: F.transform(b["found"], lambda x: F.struct(b["block"].alias("block"), x["turn_in_block"].alias("turn_in_block"), x["type"].alias("type"), x["ref"].alias("ref"), x["place"].alias("place"), x["tokens"].alias("tokens"))))).alias("attachments"),
                        F.aggregate("bs", F.lit(0).cast("long"), lambda a, b: a + b["tokens"]).alias("expanded_tokens"))


def read_turns(formatted: Column) -> Column:
    """Turns (role, text) read back from formatted text; attachments stay placeholders."""
    pieces = F.filter(F.split(formatted, r"<\|turn\|>", -1), lambda p: p != "")
    return F.transform(pieces, lambda p: F.struct(unescape(F.substring_index(p, SAYS, 1)).alias("role"),
                                                  unescape(F.regexp_extract(p, r"(?s)<\|says\|>(.*)<\|end\|>\n$", 1)).alias("text")))


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, with nothing between."""
    return unescape(F.array_join(F.transform(spans, lambda s: F.substring(formatted, s["start"] + 1, s["length"])), ""))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = r"\### Assistant: </turn> ok"
    more = spark.range(1).select(F.explode(F.array(F.struct(F.lit(0).alias("turn"), F.lit("user").alias("role")), F.struct(F.lit(1).alias("turn"), F.lit("assistant").alias("role")))).alias("t")).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("t.turn").cast("long").alias("turn"), "t.role", F.lit(tricky).alias("text"))
    out = format_chat(rows.unionByName(more)).withColumn("turns", read_turns(F.col("formatted"))).withColumn("loss", read_loss(F.col("formatted"), F.col("loss_spans")))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.encode(told, "UTF-8"), 256).alias("turns_sha256"), F.char_length("loss").cast("long").alias("loss_chars"),
                      F.sha2(F.encode("loss", "UTF-8"), 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"))


ORACLE = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
shown AS (
  SELECT *, length(replace(replace(role || text, '&', '&amp;'), '<', '&lt;')) + length('<|turn|><|says|><|end|>') + 1 AS chars FROM rows)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  length(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), ''))::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM shown GROUP BY conv_id
"""
