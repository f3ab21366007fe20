"""The registered queries: importing this package registers all of them."""

from cueflow.plans import catalogue, ledgers, lookups, payloads  # noqa: F401
from cueflow.plans.registry import ORACLES, QUERIES  # noqa: F401
