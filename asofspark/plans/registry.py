"""All registered queries of the library and their SQL."""

from __future__ import annotations

from asofspark.plans import books, checks, fundamentals, growing, panels, parts, portfolio, research, resampling, schedules, timeseries, variants

_MODULES = [fundamentals, timeseries, portfolio, research, checks, books, parts, panels, schedules, resampling, variants, growing]
QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
SQL = {name: sql for m in _MODULES for name, sql in m.SQL.items()}
