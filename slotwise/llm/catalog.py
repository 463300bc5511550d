"""One query per operator over its whole table, and its SQL where SQL can say it."""

import corpus_pipeline
from slotwise.llm import (
    decontamination,
    fingerprints,
    html_extraction,
    language_id,
    license_scan,
    lm_scoring,
    minhash_dedup,
    packing,
    sharding,
    substring_dedup,
    token_alignment,
    toxicity,
    whitening,
)

QUERIES = {
    "op1_substring_dedup": substring_dedup.op1_substring_dedup,
    "op2_benchmark_decontamination": decontamination.op2_benchmark_decontamination,
    "op3_language_id": language_id.op3_language_id,
    "op4_packing": packing.op4_packing,
    "op5_document_fingerprints": fingerprints.op5_document_fingerprints,
    "op6_license_scan": license_scan.op6_license_scan,
    "op7_html_extraction": html_extraction.op7_html_extraction,
    "op8_minhash_dedup": minhash_dedup.op8_minhash_dedup,
    "op9_lm_scoring": lm_scoring.op9_lm_scoring,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_cross_tokenizer_alignment": token_alignment.op11_cross_tokenizer_alignment,
    "op12_sharding": sharding.op12_sharding,
    "op13_embedding_whitening": whitening.op13_embedding_whitening,
    "pipeline": corpus_pipeline.run,
}
ORACLE = {
    "op1_substring_dedup": substring_dedup.SQL_1,
    "op2_benchmark_decontamination": decontamination.SQL_2,
    "op6_license_scan": license_scan.SQL_6,
    "op8_minhash_dedup": minhash_dedup.SQL_8,
    "op9_lm_scoring": lm_scoring.SQL_9,
}
