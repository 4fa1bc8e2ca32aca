"""The registered queries of the library and the DuckDB SQL that states the same results."""

from __future__ import annotations

from . import corrections, day_visits, event_sequences, floor, joins, learning, mask_views, recordings, reports, reviews, scoring

_ALL = {**event_sequences.QUERIES, **joins.QUERIES, **scoring.QUERIES, **floor.QUERIES, **reviews.QUERIES, **reports.QUERIES, **day_visits.QUERIES, **mask_views.QUERIES, **learning.QUERIES, **corrections.QUERIES, **recordings.QUERIES}

QUERIES = {name: run for name, (run, _) in _ALL.items()}
ORACLE_SQL = {name: sql for name, (_, sql) in _ALL.items() if sql}
