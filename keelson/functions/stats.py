"""Column formulas of the evaluation reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The two normal quantiles in use (fixed values).
Z_EXACT, Z_SHORT = 1.959963984540054, 1.96


def wilson(successes: Column, n: Column, z: float = Z_EXACT) -> tuple[Column, Column]:
    """Score interval within [0, 1]; null on no trials."""
    p = successes / n
    centre = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.when(n > 0, F.greatest(F.lit(0.0), centre - half)), F.when(n > 0, F.least(F.lit(1.0), centre + half))


def effective_count(weight: Column) -> dict[str, Column]:
    """Aggregates: exp of the entropy, participation and the largest share of non-negative weights; 0 without mass."""
    total = F.sum(weight)
    # -sum p ln p = ln T - sum(w ln w) / T
    entropy = F.exp(F.log(total) - F.sum(F.when(weight > 0, weight * F.log(weight)).otherwise(0.0)) / total)
    parts = {"entropy": entropy, "participation": total * total / F.sum(weight * weight), "top1": F.max(weight) / total}
    return {k: F.when(total > 0, v).otherwise(0.0) for k, v in parts.items()}
