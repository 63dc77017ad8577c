"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from . import ann, chat_format, exact_dedup, language_id, license_scan, mixing, near_dup, packing, suffix_dedup, token_files

QUERIES = {
    "op1_chat_format": chat_format.op1_chat_format,
    "op2_token_files": token_files.op2_token_files,
    "op3_near_dedup": near_dup.op3_near_dedup,
    "op4_language_id": language_id.op4_language_id,
    "op5_exact_dedup": exact_dedup.op5_exact_dedup,
    "op6_mixing": mixing.op6_mixing,
    "op7_ann": ann.op7_ann,
    "op8_packing": packing.op8_packing,
    "op9_suffix_dedup": suffix_dedup.op9_suffix_dedup,
    "op10_license_scan": license_scan.op10_license_scan,
}

#: Where SQL can't express an operator, tests/llm holds it against a brute-force version.
SQL = {
    "op1_chat_format": chat_format.SQL,
    "op5_exact_dedup": exact_dedup.SQL,
}
