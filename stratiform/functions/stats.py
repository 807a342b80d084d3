"""Evaluation statistics: columns where rows are many, plain numbers where an aggregate has made them few."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Z = 1.96


def wilson(successes: Column, total: Column) -> tuple[Column, Column]:
    """Bounds of the Wilson interval in percent, one decimal; 0 and 0 without trials."""
    p = successes / total
    denominator = 1 + Z * Z / total
    centre = (p + Z * Z / (2 * total)) / denominator
    margin = Z * F.sqrt(p * (1 - p) / total + Z * Z / (4 * total * total)) / denominator
    low = F.round(F.greatest(F.lit(0.0), centre - margin) * 100 + 1e-9, 1)
    high = F.round(F.least(F.lit(1.0), centre + margin) * 100 + 1e-9, 1)
    return F.when(total == 0, 0.0).otherwise(low), F.when(total == 0, 0.0).otherwise(high)


def by_index(sorted_values: Column, share: float) -> Column:
    """The value at index floor(n * share) of a sorted array, not interpolated."""
    return F.element_at(sorted_values, (F.floor(F.size(sorted_values) * share) + 1).cast("int"))


def mcnemar(b: int, c: int) -> tuple[float, float]:
    """Continuity-corrected chi-squared of discordant counts, and its p value."""
    if b + c == 0:
        return 0.0, 1.0
    x = max(0, abs(b - c) - 1) ** 2 / (b + c)
    return x, math.erfc(math.sqrt(x / 2))


def wilcoxon(w_plus: float, w_minus: float, n: int, ties: float = 0.0) -> float:
    """Two-sided p of the signed-rank statistic by the normal approximation; `ties` is the sum of t^3 - t."""
    spread = n * (n + 1) * (2 * n + 1) / 24 - ties / 48
    return 1.0 if spread <= 0 else math.erfc(abs(min(w_plus, w_minus) - n * (n + 1) / 4) / math.sqrt(2 * spread))


def stars(p: float | Column) -> str | Column:
    """The stars of a p value, or of a column of them."""
    if isinstance(p, Column):
        return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("n.s.")
    return "***" if p < 0.001 else "**" if p < 0.01 else "*" if p < 0.05 else "n.s."


def scaled(confidence: Column, temperature: float) -> Column:
    """A confidence after its logit is divided by a temperature."""
    c = F.greatest(F.least(confidence, F.lit(0.99)), F.lit(0.01))
    return 1 / (1 + F.exp(-F.log(c / (1 - c)) / temperature))


def erfc(x: Column) -> Column:
    """The complementary error function of x >= 0, to 1.2e-7 relative (a rational Chebyshev fit of the exponent)."""
    # The fit's coefficients, the highest power first.
    fit = (0.17087277, -0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223)
    t = 1 / (1 + x / 2)
    power = F.lit(fit[0])
    for c in fit[1:]:
        power = power * t + c
    return t * F.exp(-x * x + power)


def two_sided(z: Column) -> Column:
    """The chance of a normal deviate at least as far from 0 as z."""
    return erfc(F.abs(z) / math.sqrt(2))
