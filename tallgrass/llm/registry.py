"""The subpackage's queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from tallgrass.llm import bpe, decontaminate, importance, line_templates, nbsvm, pii, quality_rules, secrets, segment_topk, simhash, suffix_dedup, toxicity, whitening


def queries() -> dict:
    return {
        "op1_spaced_seeds": decontaminate.op1_spaced_seeds,
        "op2_line_templates": line_templates.op2_line_templates,
        "op3_quality_rules": quality_rules.op3_quality_rules,
        "op4_markov_secrets": secrets.op4_markov_secrets,
        "op5_subsequence_toxicity": toxicity.op5_subsequence_toxicity,
        "op6_simhash_vptree": simhash.op6_simhash_vptree,
        "op7_byte_bpe": bpe.op7_byte_bpe,
        "op8_bilstm_crf_pii": pii.op8_bilstm_crf_pii,
        "op9_bucket_pointer_dedup": suffix_dedup.op9_bucket_pointer_dedup,
        "op10_nbsvm_quality": nbsvm.op10_nbsvm_quality,
        "op11_segment_topk": segment_topk.op11_segment_topk,
        "op12_importance_resampling": importance.op12_importance_resampling,
        "op13_jacobi_whitening": whitening.op13_jacobi_whitening,
    }


def oracle_sql() -> dict:
    return {
        "op1_spaced_seeds": decontaminate.ORACLE,
        "op2_line_templates": line_templates.ORACLE,
        "op3_quality_rules": quality_rules.ORACLE,
        "op9_bucket_pointer_dedup": suffix_dedup.ORACLE,
        "op11_segment_topk": segment_topk.ORACLE,
        "op12_importance_resampling": importance.ORACLE,
    }
