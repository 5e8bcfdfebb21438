"""Discounts of modified Kneser-Ney models."""

from __future__ import annotations


def discounts(counts: dict[int, int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts for counts of 1, 2 and more, from the numbers of
    n-grams with counts 1 to 4. Where these are too few to tell, 0.75 at most."""
    n = [0, *(counts.get(i, 0) for i in (1, 2, 3, 4))]
    y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.0
    out = []
    for k in (1, 2, 3):
        d = k - (k + 1) * y * n[k + 1] / n[k] if n[k] and n[k + 1] and y else 0.75
        out.append(d if 0 < d < k else 0.75)
    return out[0], out[1], out[2]
