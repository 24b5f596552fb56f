"""The registered queries and their DuckDB SQL."""

from __future__ import annotations

from . import containers, derived, scans
from .flow import flagship  # noqa: F401

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _m in (scans, derived, containers):
    QUERIES |= _m.QUERIES
    ORACLES |= _m.ORACLES
