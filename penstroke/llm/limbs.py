"""Exact integer products through floating point, and eigenvectors of exact matrices.

An integer is written in limbs of LIMB bits, each within half a limb of zero. Products of limbs are below 2**38, so a float64
matrix product over up to ROWS rows is exact; sums of equal weight are put together as integers of any size.
"""

from __future__ import annotations

import numpy as np

LIMB, ROWS = 20, 1 << 13
#: Products of limbs of so many blocks of ROWS rows, and of a dozen of equal weight, can be summed in 64 bits.
BLOCKS = 128
#: Fractional bits of refined eigenvectors; an eigenvalue below the trace by more than ZERO bits is none.
BITS, ZERO = 160, 140
ROUNDS, SWEEPS = 12, 30


def limbs(values: np.ndarray) -> list[np.ndarray]:
    """Float arrays whose sum, weighted with powers of 2**LIMB, is values (int64 below 2**62, or Python integers)."""
    half, out = 1 << (LIMB - 1), []
    while True:
        low = ((values + half) & ((1 << LIMB) - 1)) - half
        out.append(low.astype(np.float64))
        values = (values - low) >> LIMB
        if not np.any(values):
            return out


def weighted_products(left: np.ndarray, right: np.ndarray) -> list[np.ndarray]:
    """int64 matrices whose sum, weighted with powers of 2**LIMB, is left.T @ right; both have at most BLOCKS * ROWS rows."""
    a, b = limbs(left), limbs(right)
    out: list[np.ndarray] = [np.zeros((left.shape[1], right.shape[1]), np.int64) for _ in range(len(a) + len(b) - 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            for at in range(0, len(x), ROWS):
                out[i + j] += (x[at : at + ROWS].T @ y[at : at + ROWS]).astype(np.int64)
    return out


def combined(parts: list[np.ndarray]) -> np.ndarray:
    """Python integers of matrices weighted with powers of 2**LIMB."""
    total = np.zeros(parts[0].shape, object)
    for k, part in enumerate(parts):
        total = total + (part.astype(object) << (LIMB * k))
    return total


def combined_floats(parts: list[np.ndarray]) -> np.ndarray:
    """Floats of matrices weighted with powers of 2**LIMB, as precise as floats are: carries leave limbs that don't cancel."""
    half, carry, out = 1 << (LIMB - 1), 0, []
    for part in [*parts, *[np.zeros_like(parts[0])] * 3]:
        part = part + carry
        low = ((part + half) & ((1 << LIMB) - 1)) - half
        out.append(low)
        carry = (part - low) >> LIMB
    total = np.zeros(parts[0].shape)
    for k in reversed(range(len(out))):
        total += out[k] * 2.0 ** (LIMB * k)
    return total


def exact_product(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """left.T @ right in Python integers."""
    return combined(weighted_products(left, right))


def _floats(values: np.ndarray, scale: int = 1) -> np.ndarray:
    """Each integer over scale, rounded once."""
    return np.array([v / scale for v in values.ravel().tolist()], np.float64).reshape(values.shape)


def _fixed(values: np.ndarray) -> np.ndarray:
    """Floats below 1 or so as integers with BITS fractional bits."""
    return np.array([int(v * 2.0**BITS) for v in values.ravel().tolist()], object).reshape(values.shape)


def rounds_of(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Every pair of n numbers once, in rounds of pairs that share none."""
    circle, out = [*range(n + n % 2)], []
    for _ in range(len(circle) - 1):
        half = len(circle) // 2
        pairs = [(min(p), max(p)) for p in zip(circle[:half], circle[:half - 1 : -1], strict=True) if max(p) < n]
        out.append((np.array([p for p, _ in pairs], np.int64), np.array([q for _, q in pairs], np.int64)))
        circle = [circle[0], circle[-1], *circle[1:-1]]
    return out


def diagonalised(s: np.ndarray) -> np.ndarray:
    """Rotations that make a symmetric positive matrix diagonal, each off-diagonal entry small beside its own two diagonal ones."""
    s, q, pairs = s.copy(), np.eye(len(s)), rounds_of(len(s))
    for _ in range(SWEEPS):
        turned = False
        for i, j in pairs:
            off, a, b = s[i, j], s[i, i], s[j, j]
            use = np.abs(off) > 1e-17 * np.sqrt(np.abs(a)) * np.sqrt(np.abs(b))
            if not use.any():
                continue
            turned = True
            i, j, off, a, b = i[use], j[use], off[use], a[use], b[use]
            with np.errstate(over="ignore"):
                t = (b - a) / (2 * off)
                t = np.where(t >= 0, 1.0, -1.0) / (np.abs(t) + np.hypot(t, 1))
            c = 1 / np.hypot(t, 1)
            z = c * t
            for m in (s, q):
                x, y = m[:, i].copy(), m[:, j].copy()
                m[:, i], m[:, j] = c * x - z * y, z * x + c * y
            x, y = s[i].copy(), s[j].copy()
            s[i], s[j] = c[:, None] * x - z[:, None] * y, z[:, None] * x + c[:, None] * y
            s[i, j] = s[j, i] = 0
            s[i, i], s[j, j] = a - t * off, b + t * off
        if not turned:
            break
    return q


def eigen(gram: np.ndarray) -> tuple[list[int], np.ndarray]:
    """Eigenvalues of a symmetric positive matrix of Python integers, falling, each with 2 * BITS fractional bits, and unit
    eigenvectors as columns of integers with BITS fractional bits.

    Library eigenvectors are off by the rounding of the largest eigenvalue, which may be far above the smallest. So the matrix is
    taken to their basis exactly, made diagonal there with small relative errors, and the basis turned accordingly, until
    nothing is left to turn. An eigenvalue of 0 stands for what is null up to ZERO bits below the trace.
    """
    d = len(gram)
    trace = sum(int(gram[k, k]) for k in range(d))
    if not trace:
        return [0] * d, _fixed(np.eye(d))
    basis = _fixed(np.linalg.eigh(_floats(gram, trace))[1])
    least, s = (trace << (2 * BITS)) >> ZERO, gram
    for _ in range(ROUNDS):
        # Newton's step makes the basis orthonormal.
        basis = (3 * (basis << (2 * BITS)) - exact_product(basis.T, exact_product(basis, basis))) >> (2 * BITS + 1)
        s = exact_product(basis, exact_product(gram, basis))
        scaled = _floats(s, trace << (2 * BITS))
        size = np.sqrt(np.array([max(scaled[k, k], 0) if s[k, k] > least else 0 for k in range(d)]))
        scaled[(size[:, None] * size) == 0] = 0
        if not np.any(np.abs(scaled - np.diag(np.diag(scaled))) > 1e-15 * size[:, None] * size):
            break
        basis = exact_product(basis.T, _fixed(diagonalised(scaled))) >> BITS
    values = [int(s[k, k]) if s[k, k] > least else 0 for k in range(d)]
    order = sorted(range(d), key=lambda k: -values[k])
    return [values[k] for k in order], basis[:, order]
