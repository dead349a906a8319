"""Registered queries over the shared tables, each with the SQL that checks it."""

from tidewire.catalog import base
from tidewire.catalog import (  # noqa: F401  (importing registers the queries)
    aggregates,
    dedups,
    filters,
    joins,
    scalars,
    sources,
    streams,
    vectors,
    windows,
)

QUERIES = base.QUERIES
ORACLES = base.ORACLES
