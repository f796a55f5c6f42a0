"""The corpus queries and their SQL, by the names that __spark_entry__.py lists."""

from __future__ import annotations

from lodestone.llm import divergence, lattice, mixing, nearest, ngram_join, packing, quality_model, quality_rules, repeats, secret_scan, simhash, spelling, url_filter

QUERIES = {
    "op1_suffix_dedup": repeats.query,
    "op10_lattice_score": lattice.query,
    "op11_source_divergence": divergence.query,
    "op12_spelling_variants": spelling.query,
    "op13_ngram_join": ngram_join.query,
    "op2_best_fit_packing": packing.query,
    "op3_simhash": simhash.query,
    "op4_source_mixing": mixing.query,
    "op5_quality_rules": quality_rules.query,
    "op6_url_filter": url_filter.query,
    "op7_nearest_neighbours": nearest.query,
    "op8_quality_classifier": quality_model.query,
    "op9_secret_scan": secret_scan.query,
}

ORACLE_SQL = {
    "op11_source_divergence": divergence.SQL,
    "op6_url_filter": url_filter.SQL,
    "op5_quality_rules": quality_rules.SQL,
}
