"""Column functions over vectors and lists of vectors.

All are built from Spark's higher-order functions and compute in double precision.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

NEVER = float("-inf")


def _doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Dot product; vectors of different widths raise an error instead of giving null."""
    product = F.aggregate(F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), product).otherwise(F.raise_error(F.lit("query and page vectors differ in width")).cast("double"))


def vector_max(v: Column) -> Column:
    """Greatest element that is a number; minus infinity if there is none."""
    return F.coalesce(F.array_max(F.filter(_doubles(v), lambda x: ~F.isnan(x))), F.lit(NEVER))


def maxsim(query: Column, page: Column) -> Column:
    """Sum over the query's vectors of the best dot product with a page vector.

    0.0 if either has no vectors.  A similarity that is no number never wins; a query vector with no other scores minus
    infinity.  Zero vectors take part like any other.
    """
    best = F.transform(query, lambda q: vector_max(F.transform(page, lambda d: dot(q, d))))
    total = F.aggregate(best, F.lit(0.0), lambda s, x: s + x)
    return F.when((F.coalesce(F.size(query), F.lit(0)) <= 0) | (F.coalesce(F.size(page), F.lit(0)) <= 0), F.lit(0.0)).otherwise(total)


def literal_vectors(vectors: Sequence[Sequence[float]]) -> Column:
    """A query's vectors as a constant of the plan."""
    if not len(vectors):
        return F.array().cast("array<array<double>>")
    return F.array(*[F.array(*[F.lit(float(x)) for x in v]) for v in vectors])


def unflatten(flat: Column, dim: int | Column) -> Column:
    """A row-major flat buffer as its vectors; what is left over at the end is ignored."""
    width = F.lit(dim) if isinstance(dim, int) else dim
    n = F.floor(F.size(flat) / width).cast("int")
    whole = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(flat, i * width + 1, width))
    return F.when(n > 0, whole).otherwise(F.array().cast("array<array<float>>"))


def l2_normalize(v: Column) -> Column:
    """The vector over its length, or over 1e-12 if that is more: zero stays zero."""
    norm = F.sqrt(F.aggregate(_doubles(v), F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(_doubles(v), lambda x: x / F.greatest(norm, F.lit(1e-12)))


def masked(v: Column, mask: Column) -> Column:
    """The vector times a 0/1 mask; masked vectors become zero and stay in their place."""
    return F.transform(_doubles(v), lambda x: x * mask.cast("double"))


def only_tokens(v: Column, token_id: Column, kept_id: Column | int) -> Column:
    """The vector if its token is the kept one (an image token), else zeros."""
    kept = token_id == (F.lit(kept_id) if isinstance(kept_id, int) else kept_id)
    return masked(v, F.coalesce(kept, F.lit(False)).cast("int"))
