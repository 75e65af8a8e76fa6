"""Registered queries of this subpackage and the SQL that checks them; the pipeline is registered where it is, at the top."""

from __future__ import annotations

from gainset.llm import op1_score, op2_exact, op3_minhash, op4_language, op5_lines, op6_bpe, op7_suffix, op8_quality, op9_phrases, op10_decontaminate


def queries() -> dict:
    return {
        "op1_masked_score": op1_score.op1_masked_score,
        "op2_exact_dedup": op2_exact.op2_exact_dedup,
        "op3_minhash_neardedup": op3_minhash.op3_minhash_neardedup,
        "op4_language_id": op4_language.op4_language_id,
        "op5_line_dedup": op5_lines.op5_line_dedup,
        "op5_passage_dedup": op5_lines.op5_passage_dedup,
        "op6_bpe": op6_bpe.op6_bpe,
        "op7_suffix_dedup": op7_suffix.op7_suffix_dedup,
        "op8_quality": op8_quality.op8_quality,
        "op9_phrase_dedup": op9_phrases.op9_phrase_dedup,
        "op10_decontaminate": op10_decontaminate.op10_decontaminate,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_exact_dedup": op2_exact.ORACLE,
        "op3_minhash_neardedup": op3_minhash.ORACLE,
        "op5_line_dedup": op5_lines.ORACLE,
        "op7_suffix_dedup": op7_suffix.ORACLE,
        "op9_phrase_dedup": op9_phrases.ORACLE,
        "op10_decontaminate": op10_decontaminate.ORACLE,
    }
