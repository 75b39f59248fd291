"""The registered queries of the library, and the SQL each is held against."""

from __future__ import annotations

from . import cases, oracles, queries, tabled

QUERIES = {**cases.QUERIES, **queries.QUERIES, **tabled.QUERIES}
ORACLES = {**cases.ORACLES, **oracles.ORACLES, **tabled.ORACLES}
