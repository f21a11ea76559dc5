"""All queries of the library by name, and the SQL that gives the same rows."""

from inkveil.plans import catalog, layers, papers

QUERIES = catalog.QUERIES | layers.QUERIES | papers.QUERIES
ORACLES = catalog.ORACLES | layers.ORACLES | layers.MASKED | papers.ORACLES
