"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from . import annsearch, contamination, langid, licences, neardup, packing, quality, suffixdedup, toxicity, urlfilter


def queries() -> dict:
    return {
        "op1_langid": langid.op1_langid,
        "op2_neardup": neardup.op2_neardup,
        "op3_decontamination": contamination.op3_decontamination,
        "op4_toxicity": toxicity.op4_toxicity,
        "op5_urls": urlfilter.op5_urls,
        "op6_suffixes": suffixdedup.op6_suffixes,
        "op7_licences": licences.op7_licences,
        "op8_packing": packing.op8_packing,
        "op9_ann": annsearch.op9_ann,
        "op10_quality": quality.op10_quality,
    }


def oracle_sql() -> dict[str, str]:
    """The other queries are models, tokenizers and searches, which SQL can't express; tests hold them against brute force."""
    return {"op2_neardup": neardup.ORACLE_OP2, "op6_suffixes": suffixdedup.ORACLE_OP6, "op7_licences": licences.oracle_op7()}
