"""Random draws that any engine can repeat.

A unit's place in a draw is the beginning of a SHA-256 digest, and its multiplicity in a resample is a random
polynomial, modulo a prime, of two residues of such a digest. Both need only integers below 2^63, so that SQL
can recompute them, and depend on nothing but seed, unit and resample, so that all tasks agree.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

PRIME = 2**31 - 1


def _digits(digest: Column, start: int, count: int) -> Column:
    return F.conv(F.substring(digest, start, count), 16, 10).cast("long")


def _digest(seed: int, column: str) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.col(column)), 256)


def draw(seed: int, column: str) -> Column:
    """A number below 2^60 for each value of a string column, by whose order units are drawn."""
    return _digits(_digest(seed, column), 1, 15)


def residues(seed: int, column: str) -> list[Column]:
    """Two residues of a unit's digest, `h1` and `h2`."""
    digest = _digest(seed, column)
    return [(_digits(digest, 1 + 15 * i, 15) % PRIME).alias(f"h{i + 1}") for i in range(2)]


def coefficients(seed: int, draws: int) -> np.ndarray:
    """Six coefficients of each resample from 1 on."""
    digests = [hashlib.sha256(f"{seed}/{b}".encode()).hexdigest() for b in range(1, draws + 1)]
    return np.array([[int(d[8 * i : 8 * i + 8], 16) % PRIME for i in range(6)] for d in digests], np.int64).reshape(-1, 6)


def poisson_steps() -> list[int]:
    """Least residues with a count of 1, 2, ...; counts rarer than the residues tell apart are left out."""
    chance, total, steps = math.exp(-1.0), 0.0, []
    while chance * PRIME >= 1:
        total += chance
        steps.append(int(total * PRIME))
        chance /= len(steps)
    return steps


def multiplicities(h1: np.ndarray, h2: np.ndarray, coefficients: np.ndarray) -> np.ndarray:
    """How often each unit appears in each resample: units x (resamples + 1), column 0 is the sample itself.

    Counts follow Poisson(1), the limit of drawing n units with replacement, independently for any two units.
    """
    a, b, c, d, e, f = coefficients.T
    t = (h1[:, None] * a + h2[:, None] * b + c) % PRIME
    u = (t * ((d * t + e) % PRIME) + f) % PRIME
    counts = np.searchsorted(np.array(poisson_steps()), u, side="right")
    return np.hstack([np.ones((len(h1), 1)), counts])
