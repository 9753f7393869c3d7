"""One query per operator, with the oracle statement where SQL can say it."""

from panelcheck.plans.catalog.registry import ORACLES, QUERIES  # noqa: F401
from panelcheck.plans.catalog import analytics, rules, crossmatch, listings, review, reference, extraction, datasets, flows, process  # noqa: F401
