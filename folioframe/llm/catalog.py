"""The subpackage's queries and their SQL."""

from __future__ import annotations

from .cotraining import op9_quality_classifier
from .extraction import op5_html_extraction
from .language import op6_language_id
from .lines import op10_line_dedup
from .mixing import op7_mix_sources
from .pieces import op3_sentencepiece
from .quality_rules import ORACLE as QUALITY_RULES_SQL
from .quality_rules import op8_quality_rules
from .simhash import op2_simhash_near_dedup
from .sketch import op4_document_fingerprints
from .url_rules import op1_url_filters


def queries() -> dict:
    return {
        "op1_url_filters": op1_url_filters,
        "op2_simhash_near_dedup": op2_simhash_near_dedup,
        "op3_sentencepiece": op3_sentencepiece,
        "op4_document_fingerprints": op4_document_fingerprints,
        "op5_html_extraction": op5_html_extraction,
        "op6_language_id": op6_language_id,
        "op7_mix_sources": op7_mix_sources,
        "op8_quality_rules": op8_quality_rules,
        "op9_quality_classifier": op9_quality_classifier,
        "op10_line_dedup": op10_line_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op8_quality_rules": QUALITY_RULES_SQL}
