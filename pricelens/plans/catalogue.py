"""Imports every catalogue module so that all queries are registered."""

from __future__ import annotations

from . import app, bus, core, extract, ml, outliers, rules, search_json, store, streams  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
