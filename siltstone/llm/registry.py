"""The registered queries of the subpackage and the SQL that states the same results."""

from __future__ import annotations

from siltstone.llm import bpe, chat, decontaminate, html, language, multiset, resample, runs, secrets, simhash, substring, toxicity, urls


def queries() -> dict:
    return {
        "op1_benchmark_decontamination": decontaminate.op1_benchmark_decontamination,
        "op2_chat_formatting": chat.op2_chat_formatting,
        "op3_substring_dedup": substring.op3_substring_dedup,
        "op4_language_id": language.op4_language_id,
        "op5_toxicity": toxicity.op5_toxicity,
        "op6_html_extraction": html.op6_html_extraction,
        "op7_secret_scans": secrets.op7_secret_scans,
        "op8_simhash_near_dedup": simhash.op8_simhash_near_dedup,
        "op9_document_fingerprints": multiset.op9_document_fingerprints,
        "op10_bpe_codec": bpe.op10_bpe_codec,
        "op11_importance_resampling": resample.op11_importance_resampling,
        "op12_periodic_runs": runs.op12_periodic_runs,
        "op13_url_filters": urls.op13_url_filters,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_chat_formatting": chat.OP2_SQL, "op3_substring_dedup": substring.OP3_SQL, "op11_importance_resampling": resample.OP11_SQL}
