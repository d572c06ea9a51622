"""Exact spectra of positive semidefinite integer matrices.

The characteristic polynomial is reduced to Hessenberg form modulo many primes and put together by
Chinese remaindering, so its coefficients are exact. All its roots are real, hence the sign changes
of the polynomial shifted to a point count the roots above that point, multiple ones included;
bisection with that count isolates the largest roots and refines them far beyond doubles. The
eigenvectors come from inverse iteration with the null space of (matrix - root) in long fixed-point
numbers. Only (dimension x dimension) numbers are handled here, whatever the number of rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from fractions import Fraction

import numpy as np

#: Significant bits of a simple root, of roots that never separate, and of the fixed-point numbers.
ROOT_BITS, CLUSTER_BITS, WORK_BITS = 160, 120, 384


def is_prime(number: int) -> bool:
    """Miller-Rabin with the witnesses that decide all numbers of 32 bits."""
    if number < 2 or any(number % p == 0 for p in (2, 3, 5, 7)):
        return number in (2, 3, 5, 7)
    odd, twos = number - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for witness in (2, 3, 5, 7):
        power = pow(witness, odd, number)
        if power in (1, number - 1):
            continue
        for _ in range(twos - 1):
            power = power * power % number
            if power == number - 1:
                break
        else:
            return False
    return True


def moduli(bound: int) -> list[int]:
    """The largest primes of 31 bits whose product exceeds ``bound``."""
    found, product, number = [], 1, (1 << 31) + 1
    while product <= bound:
        number -= 2
        if is_prime(number):
            found.append(number)
            product *= number
    return found


def coefficient_bound(matrix: list[list[int]]) -> int:
    """No coefficient exceeds this: symmetric means of roots that are not negative, of known sum."""
    d = len(matrix)
    trace = sum(matrix[i][i] for i in range(d))
    return -(-((trace + d) ** d) // d**d) if d else 1


def hessenberg(h: np.ndarray, primes: np.ndarray) -> np.ndarray:
    """Upper Hessenberg forms of (k, d, d) residues, each modulo its own prime, by similarity."""
    h, p = h.copy(), primes[:, None]
    each = np.arange(len(primes))
    for c in range(h.shape[1] - 2):
        pivot = c + 1 + np.argmax(h[:, c + 1 :, c] != 0, axis=1)
        upper, lower = h[each, c + 1].copy(), h[each, pivot].copy()
        h[each, c + 1], h[each, pivot] = lower, upper
        left, right = h[each, :, c + 1].copy(), h[each, :, pivot].copy()
        h[each, :, c + 1], h[each, :, pivot] = right, left
        head = h[:, c + 1, c].tolist()
        inverse = np.array([pow(x, -1, q) if x else 0 for x, q in zip(head, primes.tolist(), strict=True)], dtype=np.int64)
        factor = h[:, c + 2 :, c] * inverse[:, None] % p
        h[:, c + 2 :] = (h[:, c + 2 :] - factor[:, :, None] * h[:, c + 1, None, :] % p[:, :, None]) % p[:, :, None]
        h[:, :, c + 1] = (h[:, :, c + 1] + (h[:, :, c + 2 :] * factor[:, None, :] % p[:, :, None]).sum(axis=2)) % p
    return h


def polynomials(matrices: np.ndarray, primes: np.ndarray) -> np.ndarray:
    """(k, d + 1) coefficients, lowest first, of the characteristic polynomials of (k, d, d) residues."""
    k, d = matrices.shape[:2]
    h, p = hessenberg(matrices, primes), primes[:, None]
    minors = np.zeros((k, d + 1, d + 1), dtype=np.int64)
    minors[:, 0, 0] = 1
    for m in range(1, d + 1):
        last = minors[:, m - 1]
        minors[:, m, 1:] = last[:, :-1]
        minors[:, m] = (minors[:, m] - h[:, m - 1, m - 1, None] * last % p) % p
        weight, below = np.zeros((k, m - 1), dtype=np.int64), np.ones(k, dtype=np.int64)
        for i in range(m - 2, -1, -1):
            below = below * h[:, i + 1, i] % primes
            weight[:, i] = below * h[:, i, m - 1] % primes
        minors[:, m] = (minors[:, m] - (weight[:, :, None] * minors[:, : m - 1] % p[:, :, None]).sum(axis=1)) % p
    return minors[:, d]


def residues(matrix: list[list[int]], primes: list[int]) -> np.ndarray:
    """(primes, d + 1) coefficients modulo each prime, a bounded number of matrices at a time."""
    whole, d = np.array(matrix, dtype=object).reshape(len(matrix), len(matrix)), len(matrix)
    step = max(1, (1 << 21) // max(1, d * d))
    out = [np.zeros((0, d + 1), dtype=np.int64)]
    for at in range(0, len(primes), step):
        some = primes[at : at + step]
        out.append(polynomials(np.stack([(whole % q).astype(np.int64) for q in some]), np.array(some, dtype=np.int64)))
    return np.concatenate(out)


def combined(primes: list[int], values: list[list[int]]) -> list[int]:
    """The coefficients of least size that leave these ``values`` modulo each prime."""
    product = math.prod(primes)
    shares = [product // q * pow(product // q, -1, q) for q in primes]
    found = [sum(s * v for s, v in zip(shares, column, strict=True)) % product for column in zip(*values, strict=True)]
    return [c - product if 2 * c > product else c for c in found]


@dataclass(frozen=True)
class Root:
    """``multiplicity`` equal roots ``number`` / 2**``bits``."""

    number: int
    bits: int
    multiplicity: int

    @property
    def value(self) -> Fraction:
        return Fraction(self.number, 1 << self.bits)


def largest_roots(polynomial: list[int], most: int) -> list[Root]:
    """Positive roots of a monic polynomial with real roots only, largest first, ``most`` at least if there are."""
    degree = len(polynomial) - 1
    known: dict[tuple[int, int], int] = {}

    def scaled(bits: int) -> list[int]:
        return [c << bits * (degree - j) for j, c in enumerate(polynomial)]

    def above(number: int, bits: int) -> int:
        """Roots beyond number / 2**bits, by the sign changes of the shifted polynomial."""
        if (number, bits) not in known:
            c = scaled(bits)
            for i in range(degree):
                for j in range(degree - 1, i - 1, -1):
                    c[j] += number * c[j + 1]
            signs = [x > 0 for x in c if x]
            known[number, bits] = sum(a != b for a, b in zip(signs, signs[1:], strict=False))
        return known[number, bits]

    def sign(number: int, c: list[int]) -> int:
        value = 0
        for x in reversed(c):
            value = value * number + x
        return (value > 0) - (value < 0)

    found: list[Root] = []
    wanted, top = min(most, above(0, 0)), max(1, -polynomial[-2]) if degree else 1
    place = 1
    while place <= wanted:
        low, high, bits = 0, top, 0  # the root of this place is in (low, high] / 2**bits
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if above(middle, 0) >= place else (low, middle)
        while above(low, bits) - above(high, bits) > 1 and high.bit_length() < CLUSTER_BITS:
            bits, middle = bits + 1, low + high
            low, high = (middle, 2 * high) if above(middle, bits) >= place else (2 * low, middle)
        together = above(low, bits) - above(high, bits)
        if together == 1:
            steps = max(0, ROOT_BITS - high.bit_length())
            low, high, bits = low << steps, high << steps, bits + steps
            c = scaled(bits)
            odd = -1 if place % 2 else 1  # the sign just below the root of this place
            while high - low > 1:
                middle = (low + high) // 2
                at = sign(middle, c)
                if not at:
                    low, high = middle - 1, middle
                else:
                    low, high = (middle, high) if at == odd else (low, middle)
        found.append(Root(high, bits, together))
        place += together
    return found


def null_vectors(matrix: list[list[int]], root: Root) -> list[list[int]]:
    """As many independent integer vectors as the root is multiple, along its eigenvectors."""
    d = len(matrix)
    m = np.array([[matrix[i][j] << root.bits for j in range(d)] for i in range(d)], dtype=object).reshape(d, d)
    for i in range(d):
        m[i, i] -= root.number
    size = max((abs(x).bit_length() for x in m.ravel()), default=0)
    m = m * (1 << max(0, WORK_BITS - size)) >> max(0, size - WORK_BITS)
    order = list(range(d))
    for c in range(d):
        best = max(range(c, d), key=lambda r: abs(m[r, c]))
        m[[c, best]] = m[[best, c]]
        order[c], order[best] = order[best], order[c]
        m[c, c] = m[c, c] or 1
        if c + 1 < d:
            m[c + 1 :, c] = m[c + 1 :, c] * (1 << WORK_BITS) // m[c, c]
            m[c + 1 :, c + 1 :] -= m[c + 1 :, c, None] * m[c, c + 1 :][None, :] >> WORK_BITS

    def solved(right: list[int]) -> list[int]:
        x = [right[k] for k in order]
        for i in range(d):
            x[i] -= sum(m[i, j] * x[j] for j in range(i)) >> WORK_BITS
        for i in range(d - 1, -1, -1):
            x[i] = (x[i] * (1 << WORK_BITS) - sum(m[i, j] * x[j] for j in range(i + 1, d))) // m[i, i]
        return x

    def orthogonal(vectors: list[list[int]]) -> list[list[int]]:
        out: list[list[int]] = []
        for v in vectors:
            for _ in range(2):
                for u in out:
                    share, square = sum(a * b for a, b in zip(u, v, strict=True)), sum(a * a for a in u)
                    v = [b - share * a // square for a, b in zip(u, v, strict=True)]
            shift = max(abs(x).bit_length() for x in v) - WORK_BITS
            out.append([x >> shift if shift > 0 else x << -shift for x in v])
        return out

    draw = np.random.Generator(np.random.PCG64(5))
    vectors = [[int(x) | 1 for x in draw.integers(-(1 << 40), 1 << 40, d)] for _ in range(root.multiplicity)]
    for _ in range(2):
        vectors = orthogonal([solved([x << WORK_BITS for x in v]) for v in orthogonal(vectors)])
    return vectors


def unit(vector: list[int]) -> list[float]:
    """As doubles of length one; the largest entry is positive."""
    length = math.isqrt(sum(x * x for x in vector))
    turn = -1 if max(vector, key=abs) < 0 else 1
    return [turn * x / length for x in vector]
