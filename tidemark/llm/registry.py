"""The queries and SQL of this subpackage, gathered from its modules."""

from __future__ import annotations

from tidemark.llm import ann, bpe, clusters, decontaminate, divergence, html, lm, neardup, quality, repeats, secrets, sharding, urls

QUERIES = {
    **lm.QUERIES, **repeats.QUERIES, **urls.QUERIES, **sharding.QUERIES, **secrets.QUERIES, **bpe.QUERIES, **quality.QUERIES,
    **html.QUERIES, **decontaminate.QUERIES, **neardup.QUERIES, **divergence.QUERIES, **clusters.QUERIES, **ann.QUERIES,
}
SQL = {"op7_shards": sharding.op7_sql(), **decontaminate.SQL, **neardup.SQL, **repeats.SQL, **urls.SQL, **divergence.SQL, **clusters.SQL}
