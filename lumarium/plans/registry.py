"""Every registered query of the catalogue operators and its SQL."""

from __future__ import annotations

from . import flagship, q_enrich, q_ordered, q_pixels, q_scalars, q_sources  # noqa: F401  (they register their queries)
from .base import ORACLE_SQL, QUERIES  # noqa: F401
