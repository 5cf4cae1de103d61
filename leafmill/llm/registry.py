"""Queries and oracle SQL of the text operators."""

from __future__ import annotations

from . import block_labeller, brown_lm, byte_bpe, exact_dedup, line_dedup, mixing, ngram_join, one_bit_ann, pii, toxicity


def queries() -> dict:
    return {
        "op1_one_bit_ann": one_bit_ann.op1_one_bit_ann,
        "op2_source_mix": mixing.op2_source_mix,
        "op3_toxicity": toxicity.op3_toxicity,
        "op4_ngram_join": ngram_join.op4_ngram_join,
        "op5_brown_lm": brown_lm.op5_brown_lm,
        "op6_line_dedup": line_dedup.op6_line_dedup,
        "op7_block_labeller": block_labeller.op7_block_labeller,
        "op8_exact_dedup": exact_dedup.op8_exact_dedup,
        "op9_pii": pii.op9_pii,
        "op10_byte_bpe": byte_bpe.op10_byte_bpe,
    }


def oracle_sql() -> dict:
    return {"op2_source_mix": mixing.OP2_SQL, "op6_line_dedup": line_dedup.OP6_SQL, "op8_exact_dedup": exact_dedup.OP8_SQL}
