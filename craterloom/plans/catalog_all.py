"""All registered queries of the engine."""

from __future__ import annotations

from craterloom.plans import catalogs, exports, files, matches, more, pairs, points, rasters, registering, streams  # noqa: F401
from craterloom.plans.registry import COVERS, ORACLES, QUERIES  # noqa: F401
