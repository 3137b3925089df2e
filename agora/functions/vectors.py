"""Column expressions over ``array<float|double>`` embeddings.

All of these are higher-order SQL functions evaluated inside the JVM; no
Python runs per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from agora.functions.constants import QUANT_BITS


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a, b) -> Column:
    """Σ aᵢ·bᵢ in double precision."""
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda acc, v: acc + v)


def sq_norm(a) -> Column:
    return F.aggregate(_c(a), F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))


def norm(a) -> Column:
    return F.sqrt(sq_norm(a))


def cosine(a, b) -> Column:
    """cos(a, b); 0 when either vector is missing or all zeros."""
    na, nb = norm(a), norm(b)
    return F.when(_c(a).isNull() | _c(b).isNull() | (na == 0) | (nb == 0), F.lit(0.0)) \
        .otherwise(dot(a, b) / (na * nb))


def sq_euclidean(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: (x.cast("double") - y.cast("double"))
                                  * (x.cast("double") - y.cast("double"))),
                       F.lit(0.0), lambda acc, v: acc + v)


def euclidean(a, b) -> Column:
    return F.sqrt(sq_euclidean(a, b))


def l2_normalize(a, eps: float = 1e-12) -> Column:
    """x / max(‖x‖₂, eps), as double."""
    n = F.greatest(norm(a), F.lit(eps))
    return F.transform(_c(a), lambda v: v.cast("double") / n)


def quantize(a, bits: int = QUANT_BITS) -> Column:
    """round_half_even((clamp(x,-1,1)+1)/2·(2^bits−1)) as int (unsigned range)."""
    top = float(2 ** bits - 1)
    return F.transform(_c(a), lambda v: F.bround(
        (F.least(F.greatest(v.cast("double"), F.lit(-1.0)), F.lit(1.0)) + 1.0) / 2.0 * top, 0
    ).cast("int"))


def dequantize(q, bits: int = QUANT_BITS) -> Column:
    """q/(2^bits−1)·2 − 1."""
    top = float(2 ** bits - 1)
    return F.transform(_c(q), lambda v: v.cast("double") / top * 2.0 - 1.0)


def parse_embedding(text) -> Column:
    """Parse a ``[x, y, ...]`` literal to ``array<float>``; malformed → NULL.
    Never evaluates the text."""
    return F.from_json(_c(text), "array<float>")


def to_float32(a) -> Column:
    return _c(a).cast("array<float>")


def to_float64(a) -> Column:
    return _c(a).cast("array<double>")


def dim(a) -> Column:
    return F.size(_c(a))
