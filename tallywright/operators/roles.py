"""Column names that an operator's roles are bound to."""

from __future__ import annotations

import dataclasses


@dataclasses.dataclass(frozen=True)
class Roles:
    """unit: what is compared (a state); group: what it belongs to (a party); category: what is counted."""

    unit: str = "unit"
    group: str = "grp"
    category: str = "category"
    count: str = "n"
    year: str = "yr"
