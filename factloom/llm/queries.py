"""Queries of this subpackage, by the names that __spark_entry__.py registers."""

from __future__ import annotations

from . import chat, decontam, exactdedup, langid, linededup, mixing, neardedup, secrets, tokens, toxicity

QUERIES = {
    "op1_line_dedup": linededup.op1_line_dedup,
    "op2_secret_scan": secrets.op2_secret_scan,
    "op3_chat_formatting": chat.op3_chat_formatting,
    "op4_language_id": langid.op4_language_id,
    "op5_decontamination": decontam.op5_decontamination,
    "op6_token_counts": tokens.op6_token_counts,
    "op7_exact_dedup": exactdedup.op7_exact_dedup,
    "op8_source_mix": mixing.op8_source_mix,
    "op9_near_dedup": neardedup.op9_near_dedup,
    "op10_toxicity": toxicity.op10_toxicity,
}
ORACLE_SQL = {
    "op1_line_dedup": linededup.OP1_SQL,
    "op3_chat_formatting": chat.OP3_SQL,
    "op5_decontamination": decontam.OP5_SQL,
    "op7_exact_dedup": exactdedup.OP7_SQL,
    "op8_source_mix": mixing.OP8_SQL,
    "op9_near_dedup": neardedup.OP9_SQL,
}
