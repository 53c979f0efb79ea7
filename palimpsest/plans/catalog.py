"""All registered queries."""

from . import composite, facts, governing, hybrid, indexes, ingest, ledger, noted, recalling, reporting, scans, state, streams  # noqa: F401
from .registry import ORACLE_SQL, QUERIES  # noqa: F401

FLAGSHIP = "q1_hybrid_recall"
