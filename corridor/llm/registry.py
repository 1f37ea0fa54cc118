"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import corpus_pipeline

from . import conversation_repair, decontamination, embedding_dedup, license_scan, line_dedup, maxent_lm, minhash, mixing, packing, quality_classifier, quality_rules, secret_scan, spelling

QUERIES = {
    "op1_quality_classifier": quality_classifier.query,
    "op2_line_dedup": line_dedup.query,
    "op3_license_scan": license_scan.query,
    "op4_minhash": minhash.query,
    "op5_quality_rules": quality_rules.query,
    "op6_maxent_lm": maxent_lm.query,
    "op7_embedding_dedup": embedding_dedup.query,
    "op8_mixing": mixing.query,
    "op9_secret_scan": secret_scan.query,
    "op10_packing": packing.query,
    "op11_spelling": spelling.query,
    "op12_conversation_repair": conversation_repair.query,
    "op13_decontamination": decontamination.query,
    "pipeline": corpus_pipeline.run,
}

# Only what SQL can express; the others are tested against brute force.
ORACLE = {
    "op7_embedding_dedup": embedding_dedup.SQL,
    "op5_quality_rules": quality_rules.SQL,
    "op11_spelling": spelling.SQL,
    "op13_decontamination": decontamination.SQL,
}
