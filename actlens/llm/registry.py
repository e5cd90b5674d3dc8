"""The queries of this subpackage and their oracle SQL."""

from __future__ import annotations

from actlens.llm import queries_decontaminate as q6
from actlens.llm import queries_html as q4
from actlens.llm import queries_language as q5
from actlens.llm import queries_media as q10
from actlens.llm import queries_mixing as q2
from actlens.llm import queries_near as q7
from actlens.llm import queries_quality as q3
from actlens.llm import queries_substring as q9
from actlens.llm import queries_urlfilter as q1
from actlens.llm import queries_warc as q8


def queries() -> dict:
    return {
        "op1_url_filter": q1.op1_url_filter,
        "op2_mixing": q2.op2_mixing,
        "op3_quality": q3.op3_quality,
        "op4_html_text": q4.op4_html_text,
        "op5_language_id": q5.op5_language_id,
        "op6_decontamination": q6.op6_decontamination,
        "op7_ngram_jaccard": q7.op7_ngram_jaccard,
        "op8_warc": q8.op8_warc,
        "op9_substring_dedup": q9.op9_substring_dedup,
        "op10_media_columns": q10.op10_media_columns,
    }


def oracle_sql() -> dict[str, str]:
    """Queries that learn a model, or whose answer SQL can't state, have none."""
    return {"op1_url_filter": q1.OP1_SQL, "op7_ngram_jaccard": q7.OP7_SQL, "op8_warc": q8.OP8_SQL, "op10_media_columns": q10.OP10_SQL}
