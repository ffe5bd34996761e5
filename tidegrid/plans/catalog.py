"""All queries of the survey engine by name, with DuckDB SQL for their results."""

from __future__ import annotations

from . import change_queries, coverage_queries, crossing_queries, focal_queries, map_queries, mosaic_queries, raster_queries, record_queries, survey_queries, sweep_queries

FLAGSHIP = "pair_change_stats"
_PARTS = (change_queries, raster_queries, focal_queries, map_queries, survey_queries, crossing_queries, mosaic_queries, coverage_queries, record_queries, sweep_queries)
QUERIES: dict = {name: f for part in _PARTS for name, f in part.QUERIES.items()}
ORACLES: dict[str, str] = {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
