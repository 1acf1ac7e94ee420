"""All registered queries of the engine and their SQL."""

from __future__ import annotations

from tidemark.plans import q_adapters, q_clips, q_documents, q_feeds, q_grids, q_intervals, q_joins, q_landed, q_parse, q_review, q_sequence, q_state, q_streams, q_timeline

MODULES = (q_sequence, q_intervals, q_parse, q_joins, q_review, q_clips, q_grids, q_adapters, q_documents, q_feeds, q_landed, q_state, q_streams, q_timeline)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
SQL = {name: s for m in MODULES for name, s in m.SQL.items()}
