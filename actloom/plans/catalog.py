"""All queries of the core, and their SQL."""

from __future__ import annotations

from actloom.plans import nested, pipeline, retrieval, stages, streams

QUERIES = {**nested.QUERIES, **pipeline.QUERIES, **retrieval.QUERIES, **stages.QUERIES, **streams.QUERIES}
SQL = {**nested.SQL, **pipeline.SQL, **retrieval.SQL, **stages.SQL, **streams.SQL}
