"""Registers the queries of the training-data operators."""

from __future__ import annotations

from callweave.llm import decontaminate, fingerprints, fuzzy_lines, importance, language, lines, merkle, mixing, near_dups, packing, quality, suffixes, urls

QUERIES = {
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op2_quality": quality.op2_quality,
    "op3_language": language.op3_language,
    "op4_url_filter": urls.op4_url_filter,
    "op5_fuzzy_lines": fuzzy_lines.op5_fuzzy_lines,
    "op6_suffixes": suffixes.op6_suffixes,
    "op7_near_dups": near_dups.op7_near_dups,
    "op8_fingerprints": fingerprints.op8_fingerprints,
    "op9_mixing": mixing.op9_mixing,
    "op10_line_dedup": lines.op10_line_dedup,
    "op11_packing": packing.op11_packing,
    "op12_manifest": merkle.op12_manifest,
    "op13_importance": importance.op13_importance,
}
ORACLES = {
    "op4_url_filter": urls.SQL,
    "op5_fuzzy_lines": fuzzy_lines.SQL,
    "op7_near_dups": near_dups.SQL,
    "op9_mixing": mixing.SQL,
    "op10_line_dedup": lines.SQL,
    "op12_manifest": merkle.SQL,
    "op13_importance": importance.SQL,
}
