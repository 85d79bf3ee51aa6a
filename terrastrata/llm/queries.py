"""The queries of the ten operators, and SQL for those that SQL can express."""

from . import chat, decontaminate, html_main, mixing, quality, rules, shards, simhash, toxicity, urls

QUERIES = {
    "op1_chat_format": chat.query,
    "op2_hilbert_shards": shards.query,
    "op3_simhash": simhash.query,
    "op4_url_filter": urls.query,
    "op5_source_mixing": mixing.query,
    "op6_decontaminate": decontaminate.query,
    "op7_html_main_text": html_main.query,
    "op8_quality": quality.query,
    "op9_quality_rules": rules.query,
    "op10_toxicity": toxicity.query,
}
ORACLES = {
    "op1_chat_format": chat.ORACLE,
    "op4_url_filter": urls.ORACLE,
    "op6_decontaminate": decontaminate.ORACLE,
    "op7_html_main_text": html_main.ORACLE,
}
