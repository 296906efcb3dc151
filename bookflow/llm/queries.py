"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat_format, decontaminate, fill_middle, line_dedup, near_dedup, quality_rules, spelling
from .chat_format import op12_chat_format
from .decontaminate import op3_decontamination
from .fill_middle import op11_fill_in_middle
from .html_text import op9_html_text
from .language import op5_language
from .line_dedup import op10_line_dedup
from .near_dedup import op1_near_dedup
from .packing import op8_packing
from .quality_model import op2_quality_classifier
from .quality_rules import op6_quality_rules
from .secrets import op4_secrets
from .sharding import op7_jump_sharding
from .spelling import op13_spelling

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_dedup": op1_near_dedup,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_decontamination": op3_decontamination,
    "op4_secrets": op4_secrets,
    "op5_language": op5_language,
    "op6_quality_rules": op6_quality_rules,
    "op7_jump_sharding": op7_jump_sharding,
    "op8_packing": op8_packing,
    "op9_html_text": op9_html_text,
    "op10_line_dedup": op10_line_dedup,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_chat_format": op12_chat_format,
    "op13_spelling": op13_spelling,
}

SQL: dict[str, str] = {
    "op1_near_dedup": near_dedup.SQL,
    "op3_decontamination": decontaminate.SQL,
    "op6_quality_rules": quality_rules.SQL,
    "op10_line_dedup": line_dedup.SQL,
    "op11_fill_in_middle": fill_middle.SQL,
    "op12_chat_format": chat_format.SQL,
    "op13_spelling": spelling.SQL,
}
