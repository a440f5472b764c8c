"""Queries over the driver's tables with the SQL that must give the same rows."""

from checks import sources, extraction, classification, merging, scoring, reading, streaming  # noqa: F401, I001
from checks.base import CHECKS  # noqa: F401
