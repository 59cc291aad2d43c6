"""The registered queries of this subpackage and their DuckDB counterparts."""

from __future__ import annotations

from quillon.llm import chat, decontam, kneser, licenses, mixing, rules, secrets, simhash, substrings, tokens

QUERIES = {
    "op1_chat_formatting": chat.op1_chat_formatting,
    "op2_substring_dedup": substrings.op2_substring_dedup,
    "op3_mixing": mixing.op3_mixing,
    "op4_quality_rules": rules.op4_quality_rules,
    "op5_token_counts": tokens.op5_token_counts,
    "op6_simhash": simhash.op6_simhash,
    "op7_license_scans": licenses.op7_license_scans,
    "op8_quality_classifier": kneser.op8_quality_classifier,
    "op9_decontamination": decontam.op9_decontamination,
    "op10_secret_scans": secrets.op10_secret_scans,
}

ORACLES: dict[str, str] = {"op1_chat_formatting": chat.OP1_SQL, "op2_substring_dedup": substrings.OP2_SQL, "op4_quality_rules": rules.OP4_SQL}
