"""All queries by name, and SQL for each that SQL can express."""

from .plans import faces, journals, reviews

QUERIES: dict = {}
ORACLES: dict = {}
for _module in (faces, journals, reviews):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
