"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from . import decontaminate, langid, near_dedup, packing, pii, quality_crf, quality_rules, sharding, toxicity, url_filter

QUERIES = {
    "op1_near_dedup": near_dedup.query,
    "op2_quality_rules": quality_rules.query,
    "op3_langid": langid.query,
    "op4_toxicity": toxicity.query,
    "op5_quality_crf": quality_crf.query,
    "op6_sharding": sharding.query,
    "op7_packing": packing.query,
    "op8_decontaminate": decontaminate.query,
    "op9_url_filter": url_filter.query,
    "op10_pii": pii.query,
}
SQL = {"op2_quality_rules": quality_rules.SQL, "op8_decontaminate": decontaminate.SQL}
