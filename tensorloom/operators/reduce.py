"""Reductions. Each is one aggregate with partial sums; scalars stay in one-row tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tensorloom.functions import blocks as B
from tensorloom.operators.algebra import paired
from tensorloom.tensor import Tensor


def norm(t: Tensor) -> DataFrame:
    """Frobenius norm as one row (norm). Aliased: the norm of each template is taken once."""
    z = t.is_complex
    inside = F.aggregate("blk", F.lit(0.0), lambda s, x: s + B.squared(x, z))
    if t.form == "aliased":
        squares = t.templates.select("tid", inside.alias("q"))
        total = t.df.join(squares, "tid").agg(F.sum(B.squared(F.col("alpha"), z) * F.col("q")).alias("s"))
    elif t.form == "block":
        total = t.df.agg(F.sum(inside).alias("s"))
    else:
        total = t.df.agg(F.sum(B.squared(F.col("v"), z)).alias("s"))
    return total.select(F.sqrt(F.coalesce("s", F.lit(0))).alias("norm"))


def max_abs(t: Tensor) -> DataFrame:
    t = t.to_coo()
    return t.df.agg(F.coalesce(F.max(B.magnitude(F.col("v"), t.is_complex)), F.lit(0)).alias("max_abs"))


def max_norm(tensors: list[Tensor]) -> DataFrame:
    """The largest norm of some tensors, as of the sites of a chain, in one row."""
    return reduce(DataFrame.union, [norm(t) for t in tensors]).agg(F.max("norm").alias("max_norm"))


def normalised(t: Tensor) -> Tensor:
    """Divided by the largest absolute value."""
    t = t.to_coo()
    z = t.is_complex
    top = t.df.agg(F.max(B.magnitude(F.col("v"), z)).alias("__m"))  # one row
    by = F.nullif(F.col("__m"), F.lit(0))  # a zero tensor has no rows
    v = B.pair(F.col("v.re") / by, F.col("v.im") / by) if z else F.col("v") / by
    return Tensor(t.axes, t.df.crossJoin(F.broadcast(top)).select(*t.keys, v.alias("v")))


def difference(a: Tensor, b: Tensor) -> DataFrame:
    """Largest absolute difference over all coordinates, one row."""
    a, joined, x, y = paired(a, b)
    apart = F.sqrt(F.pow(x["re"] - y["re"], 2) + F.pow(x["im"] - y["im"], 2)) if a.is_complex else F.abs(x - y)
    return joined.agg(F.coalesce(F.max(apart), F.lit(0)).alias("max_diff"))


def compression(t: Tensor) -> DataFrame:
    """Blocks, templates in use, and their ratio (1 without blocks)."""
    n = t.df.agg(F.count(F.lit(1)).alias("n_blocks"), F.count_distinct("tid").alias("n_templates"))
    return n.withColumn("ratio", F.when(F.col("n_templates") > 0, F.col("n_blocks") / F.col("n_templates")).otherwise(F.lit(1.0)))


def footprint(t: Tensor) -> DataFrame:
    """Bytes of values and keys, about."""
    value = (16 if t.is_complex else 8) * (t.blksize if t.n_dense else 1)
    return t.df.agg((F.count(F.lit(1)) * (value + 4 * len(t.prefix))).alias("bytes"))


def exact_total(t: Tensor, by: list[str]) -> DataFrame:
    """Sums of doubles by axes, rounded once."""
    return B.exact_sums(t.to_coo().df, by, "v")


def distinct_prefix(t: Tensor, axis: str) -> DataFrame:
    return t.df.select(axis).distinct()
