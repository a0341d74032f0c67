"""All registered queries and their checking SQL."""

from voicelane.plans import catalog_data, catalog_files, catalog_rows, catalog_scopes  # noqa: F401  (register)
from voicelane.plans.registry import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]
