"""All registered queries of the study operators, and their SQL."""

from __future__ import annotations

from . import ecology, formats, models, networks, relational, simulation, statistics

_ALL = [relational.query, ecology.query, statistics.query, networks.query, simulation.query, models.query, formats.query]
QUERIES = {name: f for r in _ALL for name, f in r.queries.items()}
SQL = {name: s for r in _ALL for name, s in r.sql.items()}
