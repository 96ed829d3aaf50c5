"""Networks of tensors: products in an order chosen by estimated size, sandwiches, commutators, expectation values.

Catalyst doesn't move a grouped sum past a join, so the order of contractions is chosen here: the pair with the smallest
estimated result comes first, and each product is summed before the next join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tensorloom.functions import blocks as B
from tensorloom.meta import shared, size
from tensorloom.operators.algebra import conjugate, subtract
from tensorloom.operators.contract import contract
from tensorloom.operators.reduce import norm
from tensorloom.tensor import Tensor


def estimate(a: tuple, b: tuple, na: float, nb: float) -> tuple[float, tuple]:
    """Rows of the product of tensors with na and nb rows, under independence, and its axes."""
    common = shared(a, b)
    labels = {x.label for x in common}
    axes = tuple(x for x in (*a, *b) if x.label not in labels)
    return min(na * nb / size(common), float(size(axes))), axes


def chain(tensors: list[Tensor], rows: list[int] | None = None, reorder: bool = True) -> Tensor:
    """The product of all tensors. rows: known or guessed row counts; without them, dense sizes."""
    left = [(t, float(n)) for t, n in zip(tensors, rows or [size(t.axes) for t in tensors], strict=True)]
    if not reorder:
        return reduce(contract, tensors)
    while len(left) > 1:
        pairs = [(not shared(left[i][0].axes, left[j][0].axes), estimate(left[i][0].axes, left[j][0].axes, left[i][1], left[j][1])[0], i, j) for i in range(len(left)) for j in range(i + 1, len(left))]
        _, n, i, j = min(pairs)
        made = contract(left[i][0], left[j][0])
        left = [x for k, x in enumerate(left) if k not in (i, j)] + [(made, n)]
    return left[0][0]


def operator_product(a: Tensor, b: Tensor) -> Tensor:
    """(a b)(x, x') = sum over y of a(x, y) b(y, x'); both have axes x at prime levels 0 and 1."""
    left = a.relabel(lambda x: x.primed(7) if x.plev == 1 else x)
    right = b.relabel(lambda x: x.primed(7) if x.plev == 0 else x)
    return contract(left, right)


def sandwich(p: Tensor, h: Tensor) -> Tensor:
    return operator_product(operator_product(p, h), p)


def commutator(a: Tensor, b: Tensor) -> Tensor:
    ab = operator_product(a, b)
    return subtract(ab, operator_product(b, a).permute([x.col for x in ab.axes]))


def commutator_norm(a: Tensor, b: Tensor) -> DataFrame:
    return norm(commutator(a, b))


def reindexed(t: Tensor, like: Tensor) -> Tensor:
    """t with its axes, in their order, named as those of like, of the same dimensions."""
    if t.dims != like.dims:
        raise ValueError("the dimensions differ")
    return t.relabel(dict(zip(t.axes, like.axes, strict=True)).__getitem__)


def check_commute(a: Tensor, b: Tensor, tol: float = 1e-10) -> bool:
    """Whether the norm of the commutator is within tol; b takes the axes of a first."""
    return commutator_norm(a, reindexed(b, a)).first()[0] <= tol


def inner(a: Tensor, b: Tensor) -> DataFrame:
    """<a, b> in one row (v), zero too; a is conjugated."""
    return contract(conjugate(a), b).df


def expectation(state: Tensor, operator: Tensor) -> DataFrame:
    """<state, operator state> in one row (v); the state on the left is conjugated."""
    return inner(state, contract(operator, state.prime(1)))


def overlap(a: Tensor, b: Tensor) -> DataFrame:
    """|<a, b>| / (|a| |b|) in one row; 0 where one of them is zero."""
    v = inner(a, b)
    size_ = B.magnitude(F.col("v"), isinstance(v.schema["v"].dataType, T.StructType))
    both = norm(a).select(F.col("norm").alias("na")).crossJoin(norm(b).select(F.col("norm").alias("nb")))  # one row each
    return both.crossJoin(v.agg(F.coalesce(F.max(size_), F.lit(0.0)).alias("s"))).select(F.coalesce(F.col("s") / F.nullif(F.col("na") * F.col("nb"), F.lit(0.0)), F.lit(0.0)).alias("overlap"))


def hermiticity(operator: Tensor) -> DataFrame:
    """|A - A*| / |A| in one row: 0 for a Hermitian operator. Axes are x at prime levels 0 and 1."""
    swapped = operator.to_coo().relabel(lambda x: x.primed(1 - x.plev))
    apart = norm(subtract(operator.to_coo(), conjugate(swapped.permute([x.col for x in operator.axes]))))
    return apart.select(F.col("norm").alias("d")).crossJoin(norm(operator)).select(F.coalesce(F.col("d") / F.nullif(F.col("norm"), F.lit(0.0)), F.lit(0.0)).alias("ratio"))


def first_difference(steps: list[tuple[Tensor, Tensor]], tol: float) -> int | None:
    """The first step whose two tensors differ by more than tol."""
    from tensorloom.operators.reduce import difference

    return next((i for i, (a, b) in enumerate(steps) if difference(a, b).first()[0] > tol), None)
