"""A distinct count whose state stays small."""

from __future__ import annotations

import math


def distinct_up_to(column: str, limit: int) -> str:
    """SQL for the distinct non-null values of ``column``: the true count up to ``limit``, more than it beyond.

    Streams reject ``count(DISTINCT ..)`` and a collected set grows with the group. A theta sketch
    keeps every 64-bit hash until it holds 2**k of them and never reports fewer than 2**k after
    that, so with 2**k > limit the comparison with ``limit`` comes out as for the full set
    (distinct values sharing a 64-bit hash aside) while a group's state stays below 2**(k+1) hashes.
    The prefix keeps the empty string countable: the sketch skips empty input.
    """
    lg = max(4, math.ceil(math.log2(limit + 2)))
    return f"theta_sketch_estimate(theta_sketch_agg('=' || {column}, {lg}))"
