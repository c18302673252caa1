"""Registered queries with their SQL equivalents."""

from . import arriving, cleaning, modelling, response, scanning, series, sqltext, summaries  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
