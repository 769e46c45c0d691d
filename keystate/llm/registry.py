"""Queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from . import common, language_id, language_model, licences, media, mixing, multiset, packing, simhash, token_counts, token_output


def _shipping(query):
    def run(spark, sf_dir):
        common.ship(spark)
        return query(spark, sf_dir)

    return run


QUERIES = {
    "op1_hmm_scoring": language_model.query,
    "op2_range_coded_ids": token_output.query,
    "op3_simhash_components": simhash.query,
    "op4_token_counts": token_counts.query,
    "op5_best_fit_packing": packing.query,
    "op6_multiset_fingerprint": multiset.query,
    "op7_pareto_mixing": mixing.query,
    "op8_licence_rules": licences.query,
    "op9_string_kernel_language": language_id.query,
    "op10_png_media": media.query,
}
ORACLE = {
    "op8_licence_rules": licences.SQL,
    "op6_multiset_fingerprint": multiset.SQL,
    "op7_pareto_mixing": mixing.SQL,
}


def queries() -> dict:
    return {name: _shipping(q) for name, q in QUERIES.items()}


def oracle_sql() -> dict:
    return dict(ORACLE)
