"""All registered queries of the library, without the llm subpackage."""

from __future__ import annotations

from scholia.plans import analysis_queries, base, eval_queries, flow_queries, more_queries, text_queries, wider_queries  # noqa: F401

QUERIES, SQL = base.QUERIES, base.SQL
