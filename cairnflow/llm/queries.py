"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import decontaminate, fill_middle, line_dedup, pieces, pii, quality, ranked_search, sharding, simhash, substring, token_files, toxicity, warc

QUERIES = {
    "op1_token_files": token_files.op1,
    "op2_warc_revisits": warc.op2,
    "op3_toxicity": toxicity.op3,
    "op4_pseudonyms": pii.op4,
    "op5_sentencepiece": pieces.op5,
    "op6_substring_dedup": substring.op6,
    "op7_line_dedup": line_dedup.op7,
    "op8_decontamination": decontaminate.op8,
    "op9_simhash": simhash.op9,
    "op10_quality_rules": quality.op10,
    "op11_sharding": sharding.op11,
    "op12_fill_middle": fill_middle.op12,
    "op13_ranked_search": ranked_search.op13,
}

ORACLES = {
    "op2_warc_revisits": warc.ORACLE_OP2,
    "op6_substring_dedup": substring.ORACLE_OP6,
    "op7_line_dedup": line_dedup.ORACLE_OP7,
    "op10_quality_rules": quality.ORACLE_OP10,
    "op13_ranked_search": ranked_search.ORACLE_OP13,
}
