"""Queries of this subpackage and the SQL that they are compared with."""

from __future__ import annotations

from . import bpe, decontaminate, fim, language_crf, line_dedup, masked_lm, merkle, ngram_join, packing, pii, suffix_dedup, token_files, vector_join

QUERIES = {
    "op1_ngram_jaccard": ngram_join.op1_ngram_jaccard,
    "op2_language_crf": language_crf.op2_language_crf,
    "op3_skip_chain_pii": pii.op3_skip_chain_pii,
    "op4_bpe_chunks": bpe.op4_bpe_chunks,
    "op5_token_files": token_files.op5_token_files,
    "op6_masked_lm": masked_lm.op6_masked_lm,
    "op7_suffix_decontamination": decontaminate.op7_suffix_decontamination,
    "op8_suffix_dedup": suffix_dedup.op8_suffix_dedup,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "op10_vector_join": vector_join.op10_vector_join,
    "op11_merkle_manifest": merkle.op11_merkle_manifest,
    "op12_vector_best_fit": packing.op12_vector_best_fit,
    "op13_fill_in_middle": fim.op13_fill_in_middle,
}

ORACLE_SQL: dict[str, str] = {
    "op1_ngram_jaccard": ngram_join.ORACLE,
    "op7_suffix_decontamination": decontaminate.ORACLE,
    "op8_suffix_dedup": suffix_dedup.ORACLE,
    "op9_line_dedup": line_dedup.ORACLE,
    "op10_vector_join": vector_join.ORACLE,
    "op11_merkle_manifest": merkle.ORACLE,
    "op13_fill_in_middle": fim.ORACLE,
}
