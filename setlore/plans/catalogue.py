"""All named queries of the core and the SQL statement of each that SQL can express."""

from __future__ import annotations

from setlore.plans import affinity, journal, library, matching, measures, multivalue, quality, vocabulary

MODULES = (affinity, journal, library, matching, measures, multivalue, quality, vocabulary)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
