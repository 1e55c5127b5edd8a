"""Every registered query of the grid and graph operators, with its DuckDB SQL."""

from __future__ import annotations

from gridloom.plans import graphs, properties, relational

QUERIES: dict = relational.QUERIES | graphs.QUERIES | properties.QUERIES
ORACLES: dict[str, str] = relational.ORACLES | graphs.ORACLES | properties.ORACLES
