"""The queries opN_<name> of this subpackage and, where SQL can express one, its SQL."""

from __future__ import annotations

from . import conversations, ctw, fingerprint, html, jaccard, linededup, manifest, mixing, packing, quality, toxicity, urls, warc

QUERIES = {
    "op2_jaccard_join": jaccard.op2_jaccard_join,
    "op1_ctw_scores": ctw.op1_ctw_scores,
    "op6_toxicity": toxicity.op6_toxicity,
    "op8_html_extraction": html.op8_html_extraction,
    "op3_url_filters": urls.op3_url_filters,
    "op4_warc": warc.op4_warc,
    "op5_best_fit_packing": packing.op5_best_fit_packing,
    "op7_source_mixing": mixing.op7_source_mixing,
    "op9_fingerprints": fingerprint.op9_fingerprints,
    "op10_quality_rules": quality.op10_quality_rules,
    "op11_merkle_manifest": manifest.op11_merkle_manifest,
    "op12_conversation_repair": conversations.op12_conversation_repair,
    "op13_line_dedup": linededup.op13_line_dedup,
}

SQL = {
    "op3_url_filters": urls.OP3_SQL,
    "op4_warc": warc.OP4_SQL,
    "op9_fingerprints": fingerprint.OP9_SQL,
    "op10_quality_rules": quality.OP10_SQL,
    "op11_merkle_manifest": manifest.OP11_SQL,
    "op12_conversation_repair": conversations.OP12_SQL,
    "op13_line_dedup": linededup.OP13_SQL,
}
