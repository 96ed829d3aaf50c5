"""Blocks are column-major arrays. All expressions stay in the JVM; gemm_arrow is the NumPy twin for large blocks."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tensorloom.meta import strides

WIDE = 64  # up to this block size a sum is one aggregate for each place; beyond, places become rows
HEAVY = 20_000  # multiplications from which a block product goes to NumPy


def encode(cols: list[Column], dims: list[int], base: int = 1) -> Column:
    """Column-major position of 1-based coordinates, counted from `base`."""
    out = F.lit(base).cast("long")
    for c, s in zip(cols, strides(dims), strict=True):
        out = out + (c.cast("long") - 1) * s
    return out


def decode(pos: Column, dims: list[int], base: int = 0) -> list[Column]:
    """1-based coordinates of a column-major position."""
    at = pos.cast("long") - base
    return [(F.floor(at / s).cast("long") % d + 1).cast("int") for s, d in zip(strides(dims), dims, strict=True)]


def zero(kind: T.DataType) -> Column:
    """Zero of a number type or of complex numbers, which are structs of re and im."""
    return pair(F.lit(0.0), F.lit(0.0)) if isinstance(kind, T.StructType) else F.lit(0).cast(kind)


def pair(re: Column, im: Column) -> Column:
    return F.struct(re.alias("re"), im.alias("im"))


def number(c, z: bool) -> Column:
    """A Python number as a literal, complex if z."""
    return pair(F.lit(float(complex(c).real)), F.lit(float(complex(c).imag))) if z else F.lit(c)


def mul(x: Column, y: Column, z: bool = False) -> Column:
    return pair(x["re"] * y["re"] - x["im"] * y["im"], x["re"] * y["im"] + x["im"] * y["re"]) if z else x * y


def plus(x: Column, y: Column, z: bool = False) -> Column:
    return pair(x["re"] + y["re"], x["im"] + y["im"]) if z else x + y


def total(x: Column, z: bool = False) -> Column:
    """Sum as an aggregate."""
    return pair(F.sum(x["re"]), F.sum(x["im"])) if z else F.sum(x)


def squared(x: Column, z: bool = False) -> Column:
    return x["re"] * x["re"] + x["im"] * x["im"] if z else x * x


def magnitude(x: Column, z: bool = False) -> Column:
    return F.sqrt(squared(x, True)) if z else F.abs(x)


def present(x: Column, z: bool = False) -> Column:
    return (x["re"] != 0) | (x["im"] != 0) if z else x != 0


def scale(blk: Column, by: Column, z: bool = False) -> Column:
    return F.transform(blk, lambda x: mul(by, x, z))


def outer(a: Column, b: Column, z: bool = False) -> Column:
    """a is the fast index."""
    return F.flatten(F.transform(b, lambda y: F.transform(a, lambda x: mul(x, y, z))))


def gemm(a: Column, b: Column, m: int, k: int, n: int, kind: T.DataType) -> Column:
    """(m x k) times (k x n)."""
    z = isinstance(kind, T.StructType)

    def cell(t: Column) -> Column:
        row, col = t % m, F.floor(t / m).cast("int")
        return F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), zero(kind), lambda s, i: plus(s, mul(F.get(a, row + i * m), F.get(b, i + col * k), z), z))

    return F.transform(F.sequence(F.lit(0), F.lit(m * n - 1)), cell)


def gemm_arrow(df: DataFrame, a: str, b: str, out: str, m: int, k: int, n: int) -> DataFrame:
    """gemm of two columns of doubles in NumPy; the other columns stay."""
    rest = [c for c in df.columns if c not in (a, b)]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in rest) + f", `{out}` array<double>"

    def run(batches):
        for batch in batches:
            rows = batch.num_rows
            x, y = (batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(rows, -1) for c in (a, b))
            z = x.reshape(rows, k, m).transpose(0, 2, 1) @ y.reshape(rows, n, k).transpose(0, 2, 1)
            flat = z.transpose(0, 2, 1).reshape(-1)
            blocks = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * (m * n)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), blocks], [*rest, out])

    return df.mapInArrow(run, schema)


def permute(blk: Column, dims: list[int], perm: list[int]) -> Column:
    """The block with its axes in the order perm; the places are a literal computed once."""
    if list(perm) == sorted(perm):
        return blk
    old = strides(dims)
    places = [0]
    for p in perm:
        places = [q + i * old[p] for i in range(dims[p]) for q in places]
    return F.transform(F.array(*map(F.lit, places)), lambda q: F.get(blk, q))


def sum_blocks(df: DataFrame, keys: list[str], blk: str, size: int) -> DataFrame:
    """Element-wise sums of blk for each key, with partial sums before the shuffle; blocks of zeros alone go."""
    z = isinstance(df.schema[blk].dataType.elementType, T.StructType)
    if size <= WIDE:
        out = df.groupBy(*keys).agg(F.array(*[total(F.get(blk, F.lit(i)), z) for i in range(size)]).alias(blk))
    else:
        cells = df.select(*keys, F.posexplode(blk).alias("__pos", "__x")).groupBy(*keys, "__pos").agg(total(F.col("__x"), z).alias("__x"))
        out = cells.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("__pos", "__x"))), lambda c: c["__x"]).alias(blk))
    return out.where(nonzero(F.col(blk), z))


def nonzero(blk: Column, z: bool = False) -> Column:
    return F.exists(blk, lambda x: present(x, z))


def snap(x: Column, tol: float = 1e-10, z: bool = False) -> Column:
    """Values within tol of 0, 1, -1, 1/2, -1/2, 2 and -2, and of i, -i, i/2 and -i/2 among complex ones, become these."""
    out = x
    for v in (0.0, 1.0, -1.0, 0.5, -0.5, 2.0, -2.0, *((1j, -1j, 0.5j, -0.5j) if z else ())):
        out = F.when(magnitude(plus(x, number(-v, z), z), z) < tol, number(v, z)).otherwise(out)
    return out


def conj(a: Column) -> Column:
    return pair(a["re"], -a["im"])


def identity(*cols: str) -> Column:
    """128 bits that stand for a block or a pair of templates; a collision is out of reach."""
    return F.concat_ws(":", F.hex(F.xxhash64(*cols)), F.hex(F.xxhash64(F.lit(1), *cols)))


def two_product(x: Column, y: Column) -> tuple[Column, Column]:
    """The rounded product of two doubles and its rounding error, exactly: both are split into halves of 26 bits, whose products
    have no error. For magnitudes below 1e300 whose products are neither infinite nor below 1e-290."""

    def halves(a: Column) -> tuple[Column, Column]:
        wide = a * F.lit(134217729.0)  # 2 ** 27 + 1
        high = wide - (wide - a)
        return high, a - high

    (xh, xl), (yh, yl), p = halves(x), halves(y), x * y
    return p, ((xh * yh - p) + xh * yl + xl * yh) + xl * yl


def exact_sums(df: DataFrame, by: list[str], v: str) -> DataFrame:
    """Sums of the doubles v by groups, rounded once at the end.

    A double is a whole number times a power of two. Each batch adds these whole numbers by group and power, Spark adds the
    batches' sums as decimals, and each group's few dozen sums become one double. Infinite and null values give null.
    """
    kinds = [df.schema[c] for c in by]
    schema = T.StructType([*kinds, T.StructField("__e", T.IntegerType()), T.StructField("__hi", T.LongType()), T.StructField("__lo", T.LongType())])

    def partial(batches):
        for batch in batches:
            x = batch.column(len(by)).to_numpy(zero_copy_only=False).astype(np.float64)
            fine = np.isfinite(x)
            m, e = np.frexp(np.where(fine, x, 0.0))
            whole = (m * 2.0**53).astype(np.int64)
            parts = pa.table([*batch.columns[: len(by)], pa.array(np.where(fine, e, 9999).astype(np.int32)), pa.array(whole >> 27), pa.array(whole & (2**27 - 1))], names=[*by, "__e", "__hi", "__lo"])
            sums = parts.group_by([*by, "__e"]).aggregate([("__hi", "sum"), ("__lo", "sum")]).select([*by, "__e", "__hi_sum", "__lo_sum"])
            yield from sums.rename_columns([*by, "__e", "__hi", "__lo"]).cast(pa.schema([*(batch.schema.field(i) for i in range(len(by))), ("__e", pa.int32()), ("__hi", pa.int64()), ("__lo", pa.int64())])).to_batches()

    whole = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).cast("string").alias(c)
    sums = df.select(*by, F.col(v).cast("double").alias("__v")).mapInArrow(partial, schema).groupBy(*by, "__e").agg(whole("__hi"), whole("__lo"))

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        from fractions import Fraction

        out = pdf[by].iloc[:1].copy()
        exact = sum((((int(h) << 27) + int(lo)) * Fraction(2) ** (int(e) - 53) for e, h, lo in zip(pdf["__e"], pdf["__hi"], pdf["__lo"], strict=True)), Fraction(0))
        out["v"] = None if (pdf["__e"] == 9999).any() else float(exact)
        return out

    return sums.groupBy(*by).applyInPandas(finish, T.StructType([*kinds, T.StructField("v", T.DoubleType())]))
