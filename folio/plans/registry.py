"""All queries of the library's own operators, with the SQL that gives the same rows."""

from __future__ import annotations

from . import queries_build, queries_decks, queries_documents, queries_flows, queries_relations, queries_text

QUERIES = {**queries_text.QUERIES, **queries_relations.QUERIES, **queries_decks.QUERIES, **queries_build.QUERIES, **queries_documents.QUERIES, **queries_flows.QUERIES}
ORACLES = {**queries_text.ORACLES, **queries_relations.ORACLES, **queries_decks.ORACLES, **queries_build.ORACLES, **queries_documents.ORACLES, **queries_flows.ORACLES}
