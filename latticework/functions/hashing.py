"""Random draws that depend only on their key, never on how rows are partitioned or retried."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_key(*parts) -> Column:
    """md5 over the parts joined by '|'; plain Python values become literals."""
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.md5(F.concat_ws("|", *[c.cast("string") for c in cols]))


def uniform(*parts) -> Column:
    """Uniform draw in [0, 1) with 32-bit resolution."""
    return F.conv(F.substring(hash_key(*parts), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def normal(*parts) -> Column:
    """Standard normal by Box-Muller from two keyed uniforms."""
    radius = F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - uniform(*parts, "r")))
    return radius * F.cos(F.lit(2.0 * math.pi) * uniform(*parts, "t"))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value computed once, however often it is named."""
    return F.transform(F.array(value), use)[0]
