"""The registered queries of this package, and their SQL twins."""

from __future__ import annotations

from limpid.llm import (
    collocations, decontaminate, language_id, language_model, license_scan, line_quality, mixing, near_copies,
    quality_rules, repeats, sanitise, warc, whitening,
)


def queries():
    return {
        "op1_repeats": repeats.op1_repeats,
        "op2_sanitise": sanitise.op2_sanitise,
        "op3_decontaminate": decontaminate.op3_decontaminate,
        "op4_line_quality": line_quality.op4_line_quality,
        "op5_language_id": language_id.op5_language_id,
        "op6_near_copies": near_copies.op6_near_copies,
        "op7_license_scan": license_scan.op7_license_scan,
        "op8_language_model": language_model.op8_language_model,
        "op9_quality_rules": quality_rules.op9_quality_rules,
        "op10_mixing": mixing.op10_mixing,
        "op11_whitening": whitening.op11_whitening,
        "op12_warc": warc.op12_warc,
        "op13_collocations": collocations.op13_collocations,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op7_license_scan": license_scan.OP7_SQL,
        "op9_quality_rules": quality_rules.OP9_SQL,
        "op10_mixing": mixing.OP10_SQL,
        "op12_warc": warc.OP12_SQL,
        "op13_collocations": collocations.OP13_SQL,
    }
