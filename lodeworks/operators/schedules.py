"""Learning-rate curves as columns of a step."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def warmup_cosine(step: Column, base: float, steps: int, warmup: int, least: float) -> Column:
    """Linear warm-up to ``base``, then half a cosine down to ``least`` at ``steps``."""
    share = (step - warmup).cast("double") / float(max(steps - warmup, 1))
    share = F.greatest(F.least(share, F.lit(1.0)), F.lit(0.0))
    curve = F.lit(least) + (base - least) * 0.5 * (1.0 + F.cos(share * math.pi))
    return F.when(step < warmup, F.lit(base) * (step + 1) / float(warmup)).otherwise(curve) if warmup else curve


def warmup_constant(step: Column, base: float, warmup: int) -> Column:
    return F.when(step < warmup, F.lit(base) * (step + 1) / float(warmup)).otherwise(F.lit(base)) if warmup else F.lit(base)
