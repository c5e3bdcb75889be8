"""Registered queries: each pairs a Spark plan over the shared tables with its SQL twin."""

from __future__ import annotations

from chronoline.plans.base import ALL, Query  # noqa: F401
from chronoline.plans import chart, composed, derived, structures, tables, timeline  # noqa: F401
