"""The queries of this folder by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import align, bpe, fingerprint, line_dedup, lm_score, minhash, mixing, quality, secrets, simhash, toxicity, vector_codes, warc


def queries() -> dict:
    found = [
        lm_score.op1_lm_score,
        warc.op2_warc,
        line_dedup.op3_line_dedup,
        fingerprint.op4_fingerprint,
        toxicity.op5_toxicity,
        bpe.op6_bpe,
        simhash.op7_simhash,
        mixing.op8_mixing,
        secrets.op9_secrets,
        quality.op10_quality,
        align.op11_align,
        minhash.op12_minhash,
        vector_codes.op13_vector_codes,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op2_warc": warc.SQL, "op3_line_dedup": line_dedup.SQL}
