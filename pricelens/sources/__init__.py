"""Sources: driver tables, domain mapping, reference lookups, pages and topic files."""

from .tables import TABLES, price_ticks, raw_offers, searches, table  # noqa: F401
