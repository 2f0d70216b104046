"""Queries of this subpackage and their SQL, for the entry module."""

from __future__ import annotations

from . import annsearch, licenses, mixing, nearcopies, packing, pii, quality, secrets, substring, urls

QUERIES = {
    "op1_repeated_passages": substring.op1_query,
    "op2_mix_sources": mixing.op2_query,
    "op3_license_scan": licenses.op3_query,
    "op4_nearest_neighbours": annsearch.op4_query,
    "op5_secret_scan": secrets.op5_query,
    "op6_url_filter": urls.op6_query,
    "op7_jaccard_join": nearcopies.op7_query,
    "op8_quality_rules": quality.op8_query,
    "op9_pii": pii.op9_query,
    "op10_packing": packing.op10_query,
}
ORACLES = {"op1_repeated_passages": substring.OP1_SQL, "op2_mix_sources": mixing.OP2_SQL, "op6_url_filter": urls.OP6_SQL}
