"""Sums, differences, scalars and element-wise maps of tensors."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from tensorloom.functions import blocks as B
from tensorloom.operators.meet import dealt
from tensorloom.tensor import Tensor, made_of


def scaled(t: Tensor, c) -> Tensor:
    """c times t; a complex number makes it complex."""
    t = t.as_complex() if isinstance(c, complex) else t
    z = t.is_complex
    c = B.number(c, z)
    if t.form == "aliased":
        return replace(t, df=t.df.withColumn("alpha", B.mul(c, F.col("alpha"), z)))
    if t.form == "block":
        return replace(t, df=t.df.withColumn("blk", B.scale(F.col("blk"), c, z)))
    return replace(t, df=t.df.withColumn("v", B.mul(c, F.col("v"), z)))


def add(a: Tensor, b: Tensor) -> Tensor:
    """Union of the patterns; values at equal coordinates are summed, zeros go."""
    if a.is_complex != b.is_complex:
        a, b = a.as_complex(), b.as_complex()
    if a.form != "coo" or b.form != "coo":
        n = max(a.n_dense, b.n_dense)
        a, b = (t.expand() if t.form != "coo" and t.n_dense == n else t.to_block(n) for t in (a, b))
        b = b.permute([x.col for x in a.axes])
        return replace(a, df=B.sum_blocks(a.df.unionByName(b.df), a.keys, "blk", a.blksize))
    both = dealt(a.df.unionByName(b.df.select(*a.df.columns)), a.keys, made_of(a, b))
    return replace(a, df=both.groupBy(*a.keys).agg(B.total(F.col("v"), a.is_complex).alias("v"))).pruned()


def subtract(a: Tensor, b: Tensor) -> Tensor:
    return add(a, scaled(b, -1))


def paired(a: Tensor, b: Tensor):
    """Rows with the axes of a and both values as __x and __y, null where one stores nothing."""
    a, b = a.to_coo(), b.to_coo()
    if a.is_complex != b.is_complex:
        a, b = a.as_complex(), b.as_complex()
    joined = a.df.withColumnRenamed("v", "__x").join(b.df.select(*a.keys, F.col("v").alias("__y")), a.keys, "full_outer")
    return a, joined, F.coalesce("__x", B.zero(a.kind)), F.coalesce("__y", B.zero(b.kind))


def zip_map(a: Tensor, b: Tensor, f, same_pattern: bool = False) -> Tensor:
    """f of the two values at each coordinate that either stores; absent is zero. same_pattern: other patterns are an error.
    Complex values come to f as structs of re and im."""
    a, joined, x, y = paired(a, b)
    if same_pattern:
        both = F.assert_true(F.col("__x").isNotNull() & F.col("__y").isNotNull(), "the patterns differ")
        joined = joined.where(both.isNull())
    out: Column = f(x, y)
    return Tensor(a.axes, joined.select(*a.keys, out.alias("v"))).pruned()


def fill(t: Tensor, c) -> Tensor:
    """The same pattern with one value; zero gives a tensor that keeps its zeros."""
    c = B.number(c, t.is_complex)
    if t.form == "coo":
        return replace(t, df=t.df.withColumn("v", c))
    t = t.expand()
    return replace(t, df=t.df.withColumn("blk", F.transform("blk", lambda _: c)))


def conjugate(t: Tensor) -> Tensor:
    if not t.is_complex:
        return t
    if t.form == "coo":
        return replace(t, df=t.df.withColumn("v", B.conj(F.col("v"))))
    if t.form == "block":
        return replace(t, df=t.df.withColumn("blk", F.transform("blk", B.conj)))
    return replace(t, df=t.df.withColumn("alpha", B.conj(F.col("alpha"))), templates=t.templates.withColumn("blk", F.transform("blk", B.conj)))


def clean(t: Tensor, tol: float = 1e-10) -> Tensor:
    t = t.to_coo()
    return replace(t, df=t.df.withColumn("v", B.snap(F.col("v"), tol, t.is_complex))).pruned()
