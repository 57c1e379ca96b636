"""Named queries over the driver tables, each with an equivalent DuckDB statement."""

from __future__ import annotations

from vouchline.plans import card_queries, gate_queries, geometry_queries, match_queries, ocr_queries, raster_queries, source_queries, text_queries

_PARTS = [match_queries, text_queries, ocr_queries, gate_queries, geometry_queries, source_queries, card_queries, raster_queries]
QUERIES: dict = {name: f for part in _PARTS for name, f in part.QUERIES.items()}
ORACLES: dict = {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
