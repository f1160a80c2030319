"""Event-time arithmetic on epoch microseconds.

Integer arithmetic keeps bucket edges exact (a double quotient of microseconds would not) and
keeps the grouping keys fixed-width, so the aggregations stay in Spark's hash aggregate.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

MINUTE_US = 60_000_000


@dataclass(frozen=True)
class Sliding:
    """A sliding window, both lengths in whole minutes, aligned to the epoch in UTC."""

    minutes: int
    slide: int

    def __post_init__(self):
        if self.slide < 1 or self.minutes % self.slide:
            raise ValueError("the window length must be a whole multiple of the slide")

    @property
    def steps(self) -> int:
        """How many windows contain any given instant."""
        return self.minutes // self.slide

    @property
    def length_us(self) -> int:
        return self.minutes * MINUTE_US

    @property
    def slide_us(self) -> int:
        return self.slide * MINUTE_US

    @property
    def column(self) -> Column:
        """The same window as Spark's own event-time window (needed on streams)."""
        return F.window("event_time", f"{self.minutes} minutes", f"{self.slide} minutes")


EVENT_MICROS = "unix_micros(event_time)"


def bucket_start(micros: str, width: str | int) -> str:
    """SQL for the start of the bucket that holds ``micros``; also right before 1970."""
    return f"({micros} - pmod({micros}, {width}))"
