"""All registered queries: ``{name: (spark_query, sql_twin_or_None)}``."""

from __future__ import annotations

from sparkrules.plans import q_curate, q_nodes, q_notation, q_retrieve, q_runs, q_sample, q_score, q_sources, q_text

QUERIES = {
    **q_sources.QUERIES,
    **q_text.QUERIES,
    **q_curate.QUERIES,
    **q_sample.QUERIES,
    **q_retrieve.QUERIES,
    **q_nodes.QUERIES,
    **q_notation.QUERIES,
    **q_score.QUERIES,
    **q_runs.QUERIES,
}
