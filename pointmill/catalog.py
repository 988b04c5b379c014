"""The registered queries over the derived clouds, and their SQL."""

from __future__ import annotations

from pointmill.plans import nodes, points, reports  # noqa: F401  (they register)
from pointmill.plans.registry import ORACLES, QUERIES  # noqa: F401
