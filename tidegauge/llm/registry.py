"""Queries of the corpus operators and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .collocations import OP13_SQL, op13_collocations
from .decontaminate import OP5_SQL, op5_decontaminate
from .host_rules import OP8_SQL, op8_quality_rules
from .html_text import op2_html_text
from .langid import op7_language_id
from .license_scan import op10_license_scan
from .near_dedup import op3_near_dedup
from .packing import op9_packing
from .pseudo_likelihood import op1_pseudo_likelihood
from .ranked_search import OP12_SQL, op12_ranked_search
from .secrets import op4_secret_scan
from .substring_dedup import OP6_SQL, op6_substring_dedup
from .url_templates import op11_url_filter

OPERATORS = (
    op1_pseudo_likelihood,
    op2_html_text,
    op3_near_dedup,
    op4_secret_scan,
    op5_decontaminate,
    op6_substring_dedup,
    op7_language_id,
    op8_quality_rules,
    op9_packing,
    op10_license_scan,
    op11_url_filter,
    op12_ranked_search,
    op13_collocations,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in OPERATORS}


def oracle_sql() -> dict[str, str]:
    return {"op5_decontaminate": OP5_SQL, "op6_substring_dedup": OP6_SQL, "op8_quality_rules": OP8_SQL, "op12_ranked_search": OP12_SQL, "op13_collocations": OP13_SQL}
