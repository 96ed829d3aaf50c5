"""Restricted tensors: at most one nonzero column for each prefix and row, and equal coordinates on constrained axis pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tensorloom.functions import blocks as B
from tensorloom.tensor import Tensor


def representatives(n: int, pairs: list[tuple[int, int]]) -> list[int]:
    """The smallest axis tied to each axis."""
    rep = list(range(n))
    for a, b in pairs:
        low, high = sorted((rep[a], rep[b]))
        rep = [low if r == high else r for r in rep]
    return rep


def violations(t: Tensor, prefix: list[str], row: str, ties: list[tuple[str, str]] = (), atol: float = 0.0) -> DataFrame:
    """(prefix..., row, n, off): rows with n > 1 nonzeros, or with `off` entries off a tied diagonal."""
    df = t.to_coo().df.where(B.magnitude(F.col("v"), t.is_complex) > atol)
    off = F.lit(False)
    for a, b in ties:
        off |= F.col(a) != F.col(b)
    out = df.groupBy(*prefix, row).agg(F.count(F.lit(1)).alias("n"), F.sum(off.cast("long")).alias("off"))
    return out.where("n > 1 or off > 0")


def restricted(t: Tensor, prefix: list[str], row: str, ties: list[tuple[str, str]] = ()) -> Tensor:
    if not violations(t, prefix, row, ties).isEmpty():
        raise ValueError("more than one nonzero in a row, or a nonzero off a tied diagonal")
    return t


def to_restricted(t: Tensor, prefix: list[str], row: str, col: str, ties: list[tuple[str, str]] = ()) -> DataFrame:
    """The compact form (prefix..., row, sel, val): the one column of each row and its value. Axes tied to an earlier one go."""
    rep = representatives(len(prefix), [(prefix.index(a), prefix.index(b)) for a, b in ties])
    own = [p for i, p in enumerate(prefix) if rep[i] == i]
    return restricted(t, prefix, row, ties).to_coo().df.select(*own, row, F.col(col).alias("sel"), F.col("v").alias("val"))


def from_restricted(df: DataFrame, t: Tensor, prefix: list[str], row: str, col: str, ties: list[tuple[str, str]] = ()) -> Tensor:
    """The tensor of a compact form, with the axes of t."""
    rep = representatives(len(prefix), [(prefix.index(a), prefix.index(b)) for a, b in ties])
    cols = [F.col(prefix[rep[i]]).alias(p) for i, p in enumerate(prefix)]
    return Tensor.coo(df.select(*cols, row, F.col("sel").alias(col), F.col("val").alias("v")), list(t.to_coo().axes))


def prefix_states(t: Tensor, prefix: list[str], ties: list[tuple[str, str]] = ()) -> int:
    """How many prefixes the ties allow."""
    rep = representatives(len(prefix), [(prefix.index(a), prefix.index(b)) for a, b in ties])
    out = 1
    for i in set(rep):
        out *= t.axis(prefix[i]).dim
    return out
