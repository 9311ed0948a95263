"""Constants of the analytics, in one value that every operator takes."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

DAY_US = 86_400_000_000
_EPOCH = date(1970, 1, 1)


def midnight(iso: str) -> int:
    """Microseconds from the epoch to the first moment of a day, ``YYYY-MM-DD``, in UTC."""
    return (date.fromisoformat(iso) - _EPOCH).days * DAY_US


@dataclass(frozen=True)
class Spec:
    """Times are microseconds since the epoch. ``us_per_s`` is the length of a logical second, so sparse feeds can be stretched."""

    us_per_s: int = 1_000_000
    # Fixed values of the task: horizons, rebate, cap, delay, floor, windows and dates.
    taus: tuple[int, ...] = (30, 120, 300)
    rebate_bps: float = 0.5
    notional_cap: float = 100_000.0
    bybit_delay_s: float = 0.2
    turnover_min_per_day: float = 500_000.0
    momentum_s: tuple[int, ...] = (1, 5, 30)
    vol_s: tuple[int, ...] = (5, 30, 300)
    liq_s: tuple[int, ...] = (5, 30, 300)
    flow_s: tuple[int, ...] = (30, 300)
    basis_stale_s: int = 300
    cascade_gap_s: int = 10
    cascade_min_events: int = 5
    #: (label, first, end): right-exclusive; the embargo is taken off each trailing edge.
    windows: tuple[tuple[str, int, int], ...] = (
        ("train", midnight("2025-11-01"), midnight("2026-03-01")),
        ("val", midnight("2026-03-01"), midnight("2026-04-01")),
        ("test", midnight("2026-04-01"), midnight("2026-04-29")),
    )
    use_test: bool = True
    #: Length, in logical seconds, of the time buckets that as-of lookups and running sums are spread over. It is short, so that a
    #: day with very many rows is hundreds of tasks; what is carried from bucket to bucket is one row for each.
    bucket_s: int = 300

    def us(self, seconds: float) -> int:
        return int(seconds * self.us_per_s)

    @property
    def bucket_us(self) -> int:
        return self.us(self.bucket_s)

    @property
    def embargo_us(self) -> int:
        return self.us(max(self.taus))

    def split_windows(self) -> tuple[tuple[str, int, int], ...]:
        """Three windows, or two with the last one counted as validation when the test split is off."""
        if self.use_test:
            return self.windows
        (a, b, c) = self.windows
        return (a, ("val", b[1], c[2]))


#: The driver's ``events`` are sparse: a logical second is a minute there.
FIXTURE = Spec(
    us_per_s=60_000_000,
    windows=(("train", midnight("2024-01-01"), midnight("2024-01-16")), ("val", midnight("2024-01-16"), midnight("2024-01-24")), ("test", midnight("2024-01-24"), midnight("2024-01-31"))),
)
