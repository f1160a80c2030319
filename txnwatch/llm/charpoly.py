"""Exact eigenvalues and components of a symmetric positive semidefinite integer matrix.

``residues`` (one prime at a time, so primes spread over tasks): Hessenberg form modulo the prime, then the
characteristic polynomial by the recurrence over its leading minors. ``combine``: the integer coefficients
by Chinese remainders. ``eigenvalues``: a symmetric matrix has real roots only, so Descartes' rule counts
them exactly: as many roots lie above ``a`` as p(x + a) has sign changes. Bisection on exact integers
isolates the roots, Newton steps on integers (bisecting where a step leaves the interval) make them as
narrow as asked for. ``null_space``: inverse iteration on the matrix less the root, in fixed point
with pivoting, so that close eigenvalues do not blur their components.
"""

from __future__ import annotations

import math
import random

import numpy as np

PRIME_BELOW = 1 << 31  # products of two residues fit 64 bits
GUARD_BITS = 160  # of an eigenvalue below the largest one
Matrix = list[list[int]]


def primes(count: int, below: int = PRIME_BELOW) -> list[int]:
    """The ``count`` largest primes under ``below``."""
    found, n = [], below - 1
    while len(found) < count:
        if _is_prime(n):
            found.append(n)
        n -= 2
    return found


def _is_prime(n: int) -> bool:
    """Miller-Rabin with bases that decide all odd numbers of 32 bits."""
    d, s = n - 1, 0
    while not d & 1:
        d, s = d >> 1, s + 1
    for base in (2, 3, 5, 7):
        x = pow(base, d, n)
        if x not in (1, n - 1):
            for _ in range(s - 1):
                x = x * x % n
                if x == n - 1:
                    break
            else:
                return False
    return True


def primes_needed(matrix: Matrix) -> int:
    """Enough that their product exceeds twice any coefficient.

    The k-th coefficient is a sum of products of k eigenvalues of one sign, at most C(d, k) (t / d)^k
    for trace t.
    """
    d, trace = len(matrix), sum(matrix[i][i] for i in range(len(matrix)))
    mean = -(-trace // d) if d else 0
    bits = max(math.comb(d, k).bit_length() + k * mean.bit_length() for k in range(d + 1)) + 2
    return bits // (PRIME_BELOW.bit_length() - 2) + 1


def residues(matrix: Matrix, p: int) -> list[int]:
    """Coefficients of det(xI - M) modulo ``p``, constant first."""
    d = len(matrix)
    h = np.array([[x % p for x in row] for row in matrix], np.int64).reshape(d, d)
    for k in range(d - 2):
        below = np.flatnonzero(h[k + 1 :, k])
        if not len(below):
            continue
        pivot = k + 1 + below[0]
        if pivot != k + 1:
            h[[k + 1, pivot]] = h[[pivot, k + 1]]
            h[:, [k + 1, pivot]] = h[:, [pivot, k + 1]]
        factor = h[k + 2 :, k] * pow(int(h[k + 1, k]), -1, p) % p
        h[k + 2 :] = (h[k + 2 :] - factor[:, None] * h[k + 1] % p) % p
        h[:, k + 1] = (h[:, k + 1] + (h[:, k + 2 :] * factor % p).sum(axis=1)) % p
    minors = np.zeros((d + 1, d + 1), np.int64)
    minors[0, 0] = 1
    for k in range(1, d + 1):
        minors[k, 1:] = minors[k - 1, :-1]
        minors[k] = (minors[k] - h[k - 1, k - 1] * minors[k - 1]) % p
        path = 1
        for i in range(1, k):
            path = path * int(h[k - i, k - i - 1]) % p
            if not path:
                break
            minors[k] = (minors[k] - int(h[k - i - 1, k - 1]) * path % p * minors[k - i - 1]) % p
    return minors[d].tolist()


def combine(by_prime: dict[int, list[int]]) -> list[int]:
    """The integer coefficients with these residues, of least absolute value."""
    modulus = math.prod(by_prime)
    parts = []
    for p, values in by_prime.items():
        rest = modulus // p
        parts.append((rest * pow(rest, -1, p), values))
    out = []
    for place in range(len(parts[0][1])):
        x = sum(basis * values[place] for basis, values in parts) % modulus
        out.append(x - modulus if 2 * x > modulus else x)
    return out


def _shifted(coefficients: list[int], a: int) -> list[int]:
    """Coefficients of p(x + a)."""
    out = list(coefficients)
    for i in range(len(out) - 1):
        for j in range(len(out) - 2, i - 1, -1):
            out[j] += a * out[j + 1]
    return out


def _above(coefficients: list[int], a: int, scale: int) -> int:
    """How many roots, by multiplicity, exceed a / 2^scale; exact for polynomials with real roots only."""
    d = len(coefficients) - 1
    signs = [c > 0 for c in _shifted([c << (scale * (d - i)) for i, c in enumerate(coefficients)], a) if c]
    return sum(x != y for x, y in zip(signs, signs[1:]))


def eigenvalues(coefficients: list[int], most: int, guard_bits: int = GUARD_BITS) -> tuple[list[tuple[int, int]], int]:
    """The ``most`` largest positive roots, falling, as (numerator, multiplicity) over 2^scale, and scale.

    Roots are exact to ``guard_bits`` below the largest; roots closer than that count as one. A multiplicity
    may reach beyond ``most``.
    """
    d = len(coefficients) - 1
    zeros = next(i for i, c in enumerate(coefficients) if c)
    positive = coefficients[zeros:]
    trace = -coefficients[d - 1] if d else 0
    if len(positive) < 2:
        return [], 0
    scale = max(0, guard_bits - trace.bit_length())
    top = 1 << trace.bit_length()  # no root exceeds the trace
    found: list[tuple[int, int]] = []
    taken, open_ = 0, [(0, top, 0, len(positive) - 1, 0)]  # roots in (low, high] / 2^bits, counted above both
    while open_ and taken < most:
        low, high, above_high, above_low, bits = open_.pop()
        inside = above_low - above_high
        if inside == 0:
            continue
        if bits == scale and high - low == 1:
            found.append((high, inside))
        elif inside == 1 and (root := _newton(positive, low, high, bits, scale)) is not None:
            found.append((root, 1))
        else:
            if high - low == 1:
                low, high, bits = low << 1, high << 1, bits + 1
            middle = (low + high) // 2
            above = _above(positive, middle, bits)
            open_ += [(low, middle, above, above_low, bits), (middle, high, above_high, above, bits)]
            continue
        taken += inside
    return found, scale


def _value(coefficients: list[int], a: int, scale: int) -> int:
    """p(a / 2^scale) times 2^(scale degree)."""
    out, shift = 0, 0
    for c in reversed(coefficients):
        out = out * a + (c << shift)
        shift += scale
    return out


def _newton(coefficients: list[int], low: int, high: int, bits: int, scale: int) -> int | None:
    """The only root in (low, high] / 2^bits, rounded up over 2^scale; None if the ends do not differ in sign."""
    low, high = low << (scale - bits), high << (scale - bits)
    slope = [i * c for i, c in enumerate(coefficients)][1:]
    at_high = _value(coefficients, high, scale)
    if at_high == 0:
        return high
    if (_value(coefficients, low, scale) > 0) == (at_high > 0):
        return None  # another root, of even order, touches the lower end
    x, near, least = (low + high) // 2, 0, None
    while high - low > 1:
        width = high - low
        for x in (x, (low + high) // 2):
            if low < x < high:
                value = _value(coefficients, x, scale)
                if value == 0:
                    return x
                low, high = (low, x) if (value > 0) == (at_high > 0) else (x, high)
                if least is None or abs(value) < abs(least):
                    near, least = x, value
            if 2 * (high - low) <= width:
                break
        gradient = _value(slope, near, scale)
        step = -least // gradient if gradient else 0
        x = near + step + (1 if step >= 0 else -1)  # one beyond the root, so that both ends close in
    return high


def null_space(matrix: Matrix, numerator: int, multiplicity: int, scale: int, bits: int = 2 * GUARD_BITS) -> list[list[float]]:
    """``multiplicity`` orthonormal vectors that the matrix, less numerator / 2^scale, sends to about zero.

    Fixed point with ``bits`` fractional bits relative to the matrix, partial pivoting, two solves.
    """
    d = len(matrix)
    size = max(1, max(abs(x) for row in matrix for x in row)).bit_length()
    rows = [[_scaled(x, bits - size) for x in row] for row in matrix]
    root = _scaled(numerator, bits - size - scale)
    for i in range(d):
        rows[i][i] -= root
    order = list(range(d))
    for k in range(d):
        pivot = max(range(k, d), key=lambda i: abs(rows[i][k]))
        rows[k], rows[pivot] = rows[pivot], rows[k]
        order[k], order[pivot] = order[pivot], order[k]
        if rows[k][k] == 0:
            rows[k][k] = 1
        lead = rows[k]
        for i in range(k + 1, d):
            row = rows[i]
            factor = (row[k] << bits) // lead[k]
            row[k] = factor
            if factor:
                for j in range(k + 1, d):
                    row[j] -= factor * lead[j] >> bits
    found: list[list[int]] = []
    for start in range(multiplicity):
        luck = random.Random(start)  # any start will do, as long as the starts are independent
        v = [luck.randrange(-1 << bits, 1 << bits) for _ in range(d)]
        for _ in range(3):
            v = _without(_solved(rows, order, v, bits), found, bits)
        found.append(v)
    return [[x / (1 << bits) for x in v] for v in found]


def _scaled(x: int, shift: int) -> int:
    return x << shift if shift >= 0 else x >> -shift


def _solved(rows: Matrix, order: list[int], right: list[int], bits: int) -> list[int]:
    d = len(rows)
    v = [right[order[i]] for i in range(d)]
    for i in range(d):
        v[i] -= sum(rows[i][j] * v[j] for j in range(i)) >> bits
    for i in reversed(range(d)):
        v[i] = ((v[i] << bits) - sum(rows[i][j] * v[j] for j in range(i + 1, d))) // rows[i][i]
    return _unit(v, bits)


def _unit(v: list[int], bits: int) -> list[int]:
    length = max(1, math.isqrt(sum(x * x for x in v)))
    return [(x << bits) // length for x in v]


def _without(v: list[int], found: list[list[int]], bits: int) -> list[int]:
    """``v`` made orthogonal to what was found before."""
    for u in found:
        share = sum(x * y for x, y in zip(u, v)) >> bits
        v = [x - (share * y >> bits) for x, y in zip(v, u)]
    return _unit(v, bits)
