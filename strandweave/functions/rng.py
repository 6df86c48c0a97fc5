"""Counter-based randomness: a uniform is a hash of what it is for, never of when or where it is drawn.

The exact form (md5) has an SQL twin and is for decisions per row; the fast form
(xxhash64) is for decisions per base.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(*parts) -> Column:
    """In [0, 1): the first 32 bits of md5 over the parts joined by |."""
    key = F.concat_ws("|", *[(p if isinstance(p, Column) else F.lit(str(p))).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("double") / float(2**32)


def fast_uniform(*parts) -> Column:
    """In [0, 1): the top 53 bits of xxhash64 over the parts."""
    key = F.xxhash64(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    return F.shiftrightunsigned(key, 11).cast("double") / float(2**53)


def normal(*parts) -> Column:
    """Standard normal by Box-Muller on two uniforms."""
    return F.sqrt(-2 * F.ln(1 - uniform(*parts, "a"))) * F.cos(2 * math.pi * uniform(*parts, "b"))


def uniform_sql(*parts: str) -> str:
    """The SQL twin of uniform(); parts are SQL expressions."""
    key = "concat_ws('|', " + ", ".join(f"({p})::VARCHAR" for p in parts) + ")"
    return f"(('0x' || substr(md5({key}), 1, 8))::BIGINT / 4294967296.0)"


def normal_sql(*parts: str) -> str:
    return f"(sqrt(-2 * ln(1 - {uniform_sql(*parts, chr(39) + 'a' + chr(39))})) * cos(2 * pi() * {uniform_sql(*parts, chr(39) + 'b' + chr(39))}))"


def counters(seed: int, *parts: int) -> np.random.Generator:
    """A numpy generator for one row inside an Arrow UDF, keyed by the row's identity."""
    return np.random.Generator(np.random.PCG64([seed & 0xFFFFFFFF, *[int(p) & 0xFFFFFFFFFFFFFFFF for p in parts]]))
