"""The queries opN_<name> of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from callgrid.llm import (
    fill_in_middle, filter_audit, fingerprint, line_dedup, lm_score, mixing, near_dedup, packing, quality, secrets, url_filter, vector_search, warc,
)

QUERIES = {
    "op1_packing": packing.op1_packing,
    "op2_mixing": mixing.op2_mixing,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op4_url_filter": url_filter.op4_url_filter,
    "op5_quality": quality.op5_quality,
    "op6_vector_search": vector_search.op6_vector_search,
    "op7_lm_score": lm_score.op7_lm_score,
    "op8_fingerprints": fingerprint.op8_fingerprints,
    "op9_near_dedup": near_dedup.op9_near_dedup,
    "op10_warc": warc.op10_warc,
    "op11_filter_audit": filter_audit.op11_filter_audit,
    "op12_secrets": secrets.op12_secrets,
    "op13_fill_in_middle": fill_in_middle.op13_fill_in_middle,
}

ORACLES = {
    "op3_line_dedup": line_dedup.SQL,
    "op4_url_filter": url_filter.SQL,
    "op9_near_dedup": near_dedup.SQL,
    "op10_warc": warc.SQL,
    "op11_filter_audit": filter_audit.SQL,
    "op13_fill_in_middle": fill_in_middle.SQL,
}
