"""Every query of the package outside ``llm`` and its SQL."""

from __future__ import annotations

from . import attribution, composition, files, reports, text, topics  # noqa: F401  (they register their queries)
from .common import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
