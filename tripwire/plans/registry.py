"""All registered queries and oracles (importing the catalogs fills them)."""

from tripwire.plans import catalog, catalog_text, catalog_features  # noqa: F401
from tripwire.plans.catalog import ORACLE, REGISTRY

__all__ = ["ORACLE", "REGISTRY"]
