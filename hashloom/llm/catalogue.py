"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from . import decontam, fingerprint, maskedlm, neardup, pieces, pii, quality, sql, tokencount, toxicity, warc

_QUERIES = {
    "op1_rff_quality": quality.op1,
    "op2_minhash_neardup": neardup.op2,
    "op3_subsequence_toxicity": toxicity.op3,
    "op4_warc_index": warc.op4,
    "op5_token_histogram": tokencount.op5,
    "op6_masked_lm": maskedlm.op6,
    "op7_bootstrapped_pii": pii.op7,
    "op8_bottom_k_fingerprints": fingerprint.op8,
    "op9_fm_decontamination": decontam.op9,
    "op10_sampled_pieces": pieces.op10,
}

_SQL: dict[str, str] = {
    "op2_minhash_neardup": sql.OP2,
    "op4_warc_index": sql.OP4,
    "op9_fm_decontamination": sql.OP9,
}


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
