"""The corpus operators' queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import conversations, decontaminate, fingerprints, language_id, licenses, lm_score, minhash, mixing, packing, pii, spelling, substrings, warc

QUERIES = {
    "op1_language_id": language_id.op1_language_id,
    "op2_fingerprints": fingerprints.op2_fingerprints,
    "op3_near_dedup": minhash.op3_near_dedup,
    "op4_decontamination": decontaminate.op4_decontamination,
    "op5_licenses": licenses.op5_licenses,
    "op6_pii": pii.op6_pii,
    "op7_lm_scoring": lm_score.op7_lm_scoring,
    "op8_suffix_dedup": substrings.op8_suffix_dedup,
    "op9_warc": warc.op9_warc,
    "op10_mixing": mixing.op10_mixing,
    "op11_conversations": conversations.op11_conversations,
    "op12_spelling": spelling.op12_spelling,
    "op13_packing": packing.op13_packing,
}

SQL = {
    "op9_warc": warc.SQL,
    "op10_mixing": mixing.SQL,
}
