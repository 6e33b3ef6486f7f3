"""Importing this module registers every query with the registry."""

from tickvault.plans import (  # noqa: F401
    catalog_queries, flagship, ingest_queries, resolve_queries, series_queries,
    temporal_queries)
from tickvault.plans import (  # noqa: F401  (reuse oracles registered above)
    composed_queries, roundtrip_queries)
