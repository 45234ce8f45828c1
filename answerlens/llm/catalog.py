"""Queries of the operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from answerlens.llm import (
    decontamination,
    html_text,
    kernel_quality,
    licenses,
    line_dedup,
    merkle,
    packing,
    quality,
    secrets,
    simhash,
    token_files,
    toxicity,
    whitening,
)

QUERIES = {
    "op1_token_files": token_files.op1_token_files,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op4_license_scan": licenses.op4_license_scan,
    "op5_packing": packing.op5_packing,
    "op6_decontamination": decontamination.op6_decontamination,
    "op7_secret_scan": secrets.op7_secret_scan,
    "op8_quality_rules": quality.op8_quality_rules,
    "op9_simhash_trie": simhash.op9_simhash_trie,
    "op10_html_text": html_text.op10_html_text,
    "op11_kernel_quality": kernel_quality.op11_kernel_quality,
    "op12_merkle_manifest": merkle.op12_merkle_manifest,
    "op13_whitening": whitening.op13_whitening,
}
ORACLES = {
    "op3_line_dedup": line_dedup.ORACLE,
    "op6_decontamination": decontamination.ORACLE,
    "op12_merkle_manifest": merkle.ORACLE,
}
