"""Queries of the training-data operators, by name, with DuckDB SQL where it can express them."""

from weftline.llm import align, caps, chat, decontaminate, html, lm, quality, search, sentencepiece, simhash, tokens, toxicity, urls

QUERIES: dict = {
    "op1_sentencepiece": sentencepiece.op1_sentencepiece,
    "op2_decontaminate": decontaminate.op2_decontaminate,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_caps": caps.op4_caps,
    "op5_quality": quality.op5_quality,
    "op6_urls": urls.op6_urls,
    "op7_lm": lm.op7_lm,
    "op8_html": html.op8_html,
    "op9_chat": chat.op9_chat,
    "op10_simhash": simhash.op10_simhash,
    "op11_search": search.op11_search,
    "op12_token_files": tokens.op12_token_files,
    "op13_alignment": align.op13_alignment,
}
ORACLES: dict = {
    "op4_caps": caps.ORACLE,
    "op6_urls": urls.ORACLE,
    "op9_chat": chat.ORACLE,
    "op11_search": search.ORACLE,
}
