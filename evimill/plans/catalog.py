"""All named queries and oracles."""

from __future__ import annotations

from evimill.plans import corpus, inventory, logs, packages, probes, reports, study

_MODULES = [corpus, logs, inventory, study, packages, probes, reports]

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
