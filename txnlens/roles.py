"""Column roles: every operator is bound to roles instead of fixed column names."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Roles:
    """Names of the columns that play each part. ``ts`` holds integer microseconds."""

    id: str = "event_id"
    entity: str = "user_id"
    ts: str = "t"
    amount: str = "value"
    label: str = "y"
    category: str = "event_type"

    @property
    def order(self) -> list[str]:
        """The total order used everywhere: time, then id."""
        return [self.ts, self.id]


MICROS = 1_000_000
DAY_S = 86_400
