"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

from verspan.llm import alignment, chat, decontaminate, html_extract, jaccard_join, langid, line_dedup, lm_score, packing, topk, url_filter, warc, whitening

QUERIES = {
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op2_jaccard_join": jaccard_join.op2_jaccard_join,
    "op3_langid": langid.op3_langid,
    "op4_packing": packing.op4_packing,
    "op5_lm_score": lm_score.op5_lm_score,
    "op6_warc": warc.op6_warc,
    "op7_html_extract": html_extract.op7_html_extract,
    "op8_line_dedup": line_dedup.op8_line_dedup,
    "op9_chat_format": chat.op9_chat_format,
    "op10_topk": topk.op10_topk,
    "op11_whitening": whitening.op11_whitening,
    "op12_token_alignment": alignment.op12_token_alignment,
    "op13_url_filter": url_filter.op13_url_filter,
}
ORACLES = {
    "op2_jaccard_join": jaccard_join.ORACLE,
    "op6_warc": warc.ORACLE,
    "op8_line_dedup": line_dedup.ORACLE,
    "op9_chat_format": chat.ORACLE,
    "op10_topk": topk.ORACLE,
    "op13_url_filter": url_filter.ORACLE,
}
