"""All queries of the package's own operators."""

from __future__ import annotations

from . import analytics, mission_plans, relational, workflow  # noqa: F401
from .registry import ORACLE_SQL, QUERIES  # noqa: F401
