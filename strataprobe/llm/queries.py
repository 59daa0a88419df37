"""Queries and SQL of the training-data operators, by name."""

from __future__ import annotations

from . import chat, decontaminate, extraction, fingerprint, jaccard, lines, mixing, quality, runs, shards, suffixes, urls, whitening

QUERIES = {
    "op1_mix_sources": mixing.op1_mix_sources,
    "op2_fingerprint": fingerprint.op2_fingerprint,
    "op3_ngram_jaccard": jaccard.op3_ngram_jaccard,
    "op4_url_filter": urls.op4_url_filter,
    "op5_chat_format": chat.op5_chat_format,
    "op6_line_templates": lines.op6_line_templates,
    "op7_shard": shards.op7_shard,
    "op8_decontaminate": decontaminate.op8_decontaminate,
    "op9_quality": quality.op9_quality,
    "op10_suffix_dedup": suffixes.op10_suffix_dedup,
    "op11_whitening": whitening.op11_whitening,
    "op12_periodic_runs": runs.op12_periodic_runs,
    "op13_html_extraction": extraction.op13_html_extraction,
}
#: Where SQL can't express a query, tests/llm holds it against brute force or held-out labels.
SQL = {
    "op1_mix_sources": mixing.OP1_SQL,
    "op4_url_filter": urls.OP4_SQL,
    "op5_chat_format": chat.OP5_SQL,
    "op6_line_templates": lines.OP6_SQL,
    "op8_decontaminate": decontaminate.OP8_SQL,
}
