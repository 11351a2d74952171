"""Named queries over the tables of a scale factor, and the same in SQL."""

from __future__ import annotations

from . import checks, layouts, texts

QUERIES = texts.QUERIES | layouts.QUERIES | checks.QUERIES
ORACLE = texts.ORACLE | layouts.ORACLE | checks.ORACLE
