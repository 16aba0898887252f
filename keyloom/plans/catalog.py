"""All registered queries: the operators over keyspaces derived from the analytic tables."""

from . import catalog_collections, catalog_keys, catalog_replay, catalog_zsets  # noqa: F401
