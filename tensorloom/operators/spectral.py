"""Singular values and eigenvalues of whole matrices, whose rows and columns are distributed.

A matrix is a tensor whose axes fall into row axes and column axes. Nothing as long as a row or a column comes to the driver or to one
task: vectors are tables, `width` of them side by side as the block of a row. Only width x width numbers are gathered, FAN pieces
at a time, and the width is a checked parameter.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tensorloom.functions import blocks as B
from tensorloom.meta import Axis, size, strides
from tensorloom.operators.contract import contract
from tensorloom.operators.factor import fixed_basis, runs_of_equals
from tensorloom.operators.meet import FEW
from tensorloom.operators.reduce import norm
from tensorloom.sources.shared import written
from tensorloom.tensor import Tensor

WIDEST = 1024
FAN = 16
NUMBERS = 1 << 20  # of dense rows made at once


@dataclass(frozen=True)
class Factors:
    """left (row axes ; bond) and right (column axes ; bond) hold singular vectors in blocks; values are the singular ones, falling."""

    left: Tensor
    right: Tensor
    values: np.ndarray

    def table(self, spark) -> DataFrame:
        return spark.createDataFrame([(i + 1, float(s)) for i, s in enumerate(self.values)], "k int, sv double")

    def product(self) -> Tensor:
        """The matrix of the factors. Rows of one side meet a small other side, of FEW numbers, where they lie, and are blocks then."""
        short, long = (self.left, self.right) if size(self.left.axes) <= size(self.right.axes) else (self.right, self.left)
        if 0 < len(self.values) and size(short.axes) <= FEW:
            m = np.zeros((len(self.values), size(short.prefix)))
            weights = strides([a.dim for a in short.prefix])
            for row in short.df.collect():  # at most FEW numbers
                m[:, sum((row[c] - 1) * w for c, w in zip(short.keys, weights, strict=True))] = row.blk
            rows = times(long, self.values[:, None] * m)
            return Tensor((*long.prefix, *short.prefix), rows.df, len(short.prefix))
        scaled = self.left.df.withColumn("blk", F.zip_with("blk", F.array(*map(F.lit, self.values.tolist())), lambda x, s: x * s))
        return contract(Tensor(self.left.axes, scaled, 1), self.right, plan="block")


def _arrays(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return batch.column("blk").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, width)


def _gathered(y: DataFrame, partial, together) -> np.ndarray | None:
    """partial(batches) -> one array a task; together(arrays) -> one of several. FAN of them reach the driver."""
    schema = "part binary, rows int"

    def first(batches):
        m = partial(batches)
        if m is not None:
            yield pa.RecordBatch.from_arrays([pa.array([m.tobytes()], pa.binary()), pa.array([len(m)], pa.int32())], ["part", "rows"])

    def unpacked(rows):
        return [np.frombuffer(p, float).reshape(n, -1) for p, n in rows]

    def second(batches):
        held = None
        for batch in batches:
            some = unpacked(zip(batch.column("part").to_pylist(), batch.column("rows").to_pylist(), strict=True))
            held = together([*([] if held is None else [held]), *some])
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([held.tobytes()], pa.binary()), pa.array([len(held)], pa.int32())], ["part", "rows"])

    rows = y.mapInArrow(first, schema).repartition(FAN).mapInArrow(second, schema).collect()  # at most FAN rows
    return together(unpacked((bytes(r.part), r.rows) for r in rows)) if rows else None


def _triangle(y: DataFrame, width: int) -> np.ndarray:
    """The triangle of the tall matrix whose rows are the blocks of y, by a tree of QR steps."""

    def partial(batches):
        held, some = np.zeros((0, width)), False
        for batch in batches:
            if batch.num_rows:
                held, some = np.linalg.qr(np.vstack([held, _arrays(batch, width)]), mode="r"), True
        return held if some else None

    found = _gathered(y, partial, lambda ms: np.linalg.qr(np.vstack(ms), mode="r"))
    return np.zeros((0, width)) if found is None else found


def times(y: Tensor, m: np.ndarray) -> Tensor:
    """The blocks of y as rows, times a small matrix."""
    width, out = m.shape
    keys = y.keys
    schema = ", ".join(f"`{c}` {y.df.schema[c].dataType.simpleString()}" for c in keys) + ", blk array<double>"

    def run(batches):
        for batch in batches:
            z = _arrays(batch, width) @ m
            rows = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * out), pa.array(z.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keys), rows], [*keys, "blk"])

    return Tensor((*y.prefix, Axis(y.tail[0].name, out)), y.df.select(*keys, "blk").mapInArrow(run, schema), 1)


def orthonormal(y: Tensor, tol: float = 1e-12) -> Tensor:
    """An orthonormal basis of the span of y's columns, as blocks; dependent columns go. Twice, so that rounding leaves no trace."""
    for i in range(2):
        y = Tensor(y.axes, written(y.df, "columns"), 1)
        _, s, vt = np.linalg.svd(_triangle(y.df, y.blksize), full_matrices=False)
        rank = int((s > (tol if i == 0 else 0.5) * s[0]).sum()) if len(s) and s[0] > 0 else 0
        if not rank:
            return Tensor((*y.prefix, Axis(y.tail[0].name, 1)), y.df.limit(0), 1)
        y = times(y, vt[:rank].T / s[:rank])
    return y


def _tall_svd(t: Tensor, long: list[Axis], short: list[Axis], bond: str, tol: float) -> tuple[Tensor, Tensor, np.ndarray]:
    """The vectors of the short axes and of the long ones, and the values: a row of the matrix for each coordinate of the long axes is a
    block as wide as the short axes, a tree of QR steps gives the triangle of all rows, whose SVD has the values and the short
    vectors, and the long ones are the rows times these."""
    n = size(short)
    keys = [a.col for a in long]
    place = B.encode([F.col(a.col) for a in short], [a.dim for a in short], 0).cast("int")
    entries = t.df.groupBy(*keys).agg(F.collect_list(F.struct(place.alias("place"), "v")).alias("blk"))
    schema = ", ".join(f"`{c}` {t.df.schema[c].dataType.simpleString()}" for c in keys) + ", blk array<double>"

    def dense(batches):
        for batch in batches:
            column = batch.column("blk")
            inside, rows = column.flatten(), np.repeat(np.arange(batch.num_rows), column.value_lengths().to_numpy())
            for at in range(0, batch.num_rows, max(1, NUMBERS // n)):
                part = (rows >= at) & (rows < at + max(1, NUMBERS // n))
                m = np.zeros((min(batch.num_rows - at, max(1, NUMBERS // n)), n))
                np.add.at(m, (rows[part] - at, inside.field("place").to_numpy()[part]), inside.field("v").to_numpy()[part])
                ends = pa.array(np.arange(len(m) + 1, dtype=np.int32) * n)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(at, len(m)) for c in keys), pa.ListArray.from_arrays(ends, pa.array(m.ravel()))], [*keys, "blk"])

    y = Tensor((*long, Axis(bond, n)), written(entries.mapInArrow(dense, schema), "rows"), 1)
    _, s, vt = np.linalg.svd(_triangle(y.df, n), full_matrices=False)
    rank = int((s > tol * s[0]).sum()) if len(s) else 0
    s, v = s[:rank], vt[:rank].T
    places = np.stack(np.unravel_index(np.arange(n), [a.dim for a in short], order="F"), axis=1) + 1  # blocks are column-major
    kinds = dict(t.df.dtypes)
    schema = ", ".join(f"`{a.col}` {kinds[a.col]}" for a in short) + ", blk array<double>"
    rows = [(*map(int, place), row.tolist()) for place, row in zip(places, v, strict=True) if row.any()]  # at most n x n numbers
    small = Tensor((*short, Axis(bond, max(1, rank))), t.df.sparkSession.createDataFrame(rows, schema), 1)
    return small, times(y, v / s) if rank else Tensor((*long, Axis(bond, 1)), y.df.limit(0), 1), s


def full_svd(t: Tensor, rows: list[str], width: int, rounds: int = 2, tol: float = 1e-12, stable: bool = False, seed: int = 1) -> Factors:
    """The `width` largest singular values and vectors of the matrix (row axes) x (other axes), all of them if its rank is not above
    the width; real values.

    Columns are mixed with normal random numbers, which depend on their coordinates alone, so the product's span holds the leading
    left vectors; each further round multiplies by the matrix and its transpose and sharpens it (error falls with the power 2 * rounds
    + 1 of the ratio of left-out to kept values). Bases are made orthonormal by trees of QR steps. The small factor's SVD gives
    the values; left and right vectors come from one product each. Where a side is no longer than the width, none of this is needed:
    the matrix lies in rows as wide as that side, and one tree of QR steps has all of it. stable: vectors of equal values are turned to a basis that
    doesn't depend on rounding or on the order of rows (see gauge_fixed), which also fixes signs.
    """
    if not 1 <= width <= WIDEST:
        raise ValueError(f"a width from 1 to {WIDEST}")
    if t.is_complex:
        raise ValueError("real values only; see block_svd for complex blocks")
    t = t.to_coo()
    t = Tensor(t.axes, t.df.withColumn("v", F.col("v").cast("double")))
    left = [a for a in t.axes if a.col in rows or a.name in rows]
    right = [a for a in t.axes if a not in left]
    cols, bond = [a.col for a in right], "bond"
    while any(bond in (a.col, a.name) for a in t.axes):
        bond += "_"
    short, long = (left, right) if size(left) <= size(right) else (right, left)
    if size(short) <= width:
        small, large, s = _tall_svd(t, long, short, bond, tol)
        found = Factors(*((small, large) if short is left else (large, small)), s)
        return gauge_fixed(found) if stable else found
    share = lambda k, part: (F.shiftrightunsigned(F.xxhash64(*cols, k, F.lit(seed), F.lit(part)), 11).cast("double") + 1) / 2.0**53
    # normal numbers: signs alone are too often dependent where a side is short
    drawn = F.transform(F.sequence(F.lit(1), F.lit(width)), lambda k: F.sqrt(-2 * F.log(share(k, 0))) * F.cos(2 * np.pi * share(k, 1)))
    x = Tensor((*right, Axis(bond, width)), written(t.df.select(*cols).distinct().withColumn("blk", drawn), "drawn"), 1)
    q = None
    for _ in range(rounds + 1):
        q = orthonormal(contract(t, x, plan="block"), tol)
        x = contract(t, q, plan="block").permute([*cols, q.tail[0].col])
        x = Tensor(x.axes, written(x.df, "projected"), 1)
    w = q.blksize
    # t = q x', and x = p r with r = v s u' : right vectors x v / s, left vectors q v
    _, s, vt = np.linalg.svd(_triangle(x.df, w), full_matrices=False)
    rank = int((s > tol * s[0]).sum()) if len(s) else 0
    found = Factors(times(q, vt[:rank].T), times(x, vt[:rank].T / s[:rank]), s[:rank])
    return gauge_fixed(found) if stable else found


def _weights(keys: list[Column], axes: tuple[Axis, ...]) -> list[Column]:
    """Three weights of a row, by its place among all coordinates."""
    total = float(np.prod([float(a.dim) for a in axes]))
    place = F.lit(1.0)
    for c, s in zip(keys, strides([a.dim for a in axes]), strict=True):
        place = place + (c.cast("double") - 1) * float(s)
    share = place / (total + 1)
    return [place * (1 + share), F.sin(place * 0.7 + 0.3) + share, F.pow(place, 1.3) + F.cos(place * 0.3)]


def gauge_fixed(f: Factors, tol: float = 1e-10, gap: float = 1e-10) -> Factors:
    """The same matrix with vectors that depend on it alone. Among equal singular values (within tol of the largest) any rotation of
    the vectors is as good; the basis chosen is that which makes a weighted inner product diagonal, of the first of three weights
    whose eigenvalues lie apart by `gap`. Signs make the sum of x |x| positive over each left vector.

    The weighted inner products of all columns and the signs are sums over the rows of the left vectors, one pass each.
    """
    n = len(f.values)
    if not n:
        return f
    rows = f.left.df.select(*f.left.keys, "blk", *[w.alias(f"w{i}") for i, w in enumerate(_weights([F.col(k) for k in f.left.keys], f.left.prefix))])
    rows = written(rows, "weighted")
    left = Tensor(f.left.axes, rows.select(*f.left.keys, "blk"), 1)

    def partial(batches):
        held = None
        for batch in batches:
            if batch.num_rows:
                u = _arrays(batch, n)
                sums = np.vstack([u.T @ (batch.column(f"w{i}").to_numpy()[:, None] * u) for i in range(3)])
                held = sums if held is None else held + sums
        return held

    inner = _gathered(rows, partial, sum).reshape(3, n, n)
    turn = np.eye(n)
    for start, end in runs_of_equals(f.values, tol * max(1.0, f.values[0])):
        if end - start > 1:
            turn[start:end, start:end] = fixed_basis([m[start:end, start:end] for m in inner], gap)
    left = times(left, turn)
    left = Tensor(left.axes, written(left.df, "turned"), 1)

    def signed(batches):
        held = None
        for batch in batches:
            if batch.num_rows:
                u = _arrays(batch, n)
                sums = (u * np.abs(u)).sum(axis=0)[None]
                held = sums if held is None else held + sums
        return held

    phases = np.where(_gathered(left.df, signed, sum)[0] < 0, -1.0, 1.0)
    return Factors(times(left, np.diag(phases)), times(f.right, turn * phases), f.values)


def lanczos(t: Tensor, row: str, col: str, steps: int, tol: float = 1e-10, seed: int = 1) -> tuple[np.ndarray, Tensor]:
    """Eigenvalues of a symmetric matrix from its Krylov space of up to `steps` vectors, falling, and the Ritz vector of the largest.

    Each step multiplies the last vector by the matrix, takes out all earlier ones twice, and writes the new one, so plans don't
    grow and a lost executor costs one step. Vectors are tables; only inner products, one for each vector so far, and the
    steps x steps tridiagonal problem are on the driver. Ends early where the space is closed under the matrix.
    """
    if not 1 <= steps <= WIDEST:
        raise ValueError(f"from 1 to {WIDEST} steps")
    a, b = t.axis(row), t.axis(col)
    t = t.to_coo()
    t = Tensor(t.axes, t.df.withColumn("v", F.col("v").cast("double")))
    start = t.df.select(F.col(b.col)).distinct().withColumn("v", F.pmod(F.xxhash64(b.col, F.lit(seed)), F.lit(1000)) / 1000.0 + 0.5)
    length = norm(Tensor((b,), start)).first()[0]
    if not length:
        return np.zeros(0), Tensor((b,), start)
    basis = written(start.select(F.lit(0).alias("step"), b.col, (F.col("v") / length).alias("v")), "krylov")
    alpha, beta = [], []
    for step in range(steps):
        last = Tensor((b,), basis.where(F.col("step") == step).select(b.col, "v"))
        y = contract(t, last).df.select(F.col(a.col).alias(b.col), "v")
        y = written(y, "product")
        size_ = float(norm(Tensor((b,), y)).first()[0])
        for again in range(2):
            dots = {r.step: r.d for r in basis.join(y.withColumnRenamed("v", "__y"), b.col).groupBy("step").agg(F.sum(F.col("v") * F.col("__y")).alias("d")).collect()}  # one number a step
            if not again:
                alpha.append(dots.get(step, 0.0))
            by = F.create_map(*[x for s in range(step + 1) for x in (F.lit(s), F.lit(float(dots.get(s, 0.0))))])
            off = basis.select(b.col, (-F.col("v") * F.element_at(by, F.col("step"))).alias("v"))
            y = written(y.union(off).groupBy(b.col).agg(F.sum("v").alias("v")), "rest")
        rest = float(norm(Tensor((b,), y)).first()[0])
        if step + 1 == steps or rest <= tol * max(size_, 1e-300):
            break
        beta.append(rest)
        more = y.select(F.lit(step + 1).alias("step"), b.col, (F.col("v") / rest).alias("v"))
        basis = basis.union(written(more, "krylov"))
    n = len(alpha)
    values, vectors = np.linalg.eigh(np.diag(alpha) + np.diag(beta[: n - 1], 1) + np.diag(beta[: n - 1], -1))
    by = F.create_map(*[x for s in range(n) for x in (F.lit(s), F.lit(float(vectors[s, -1])))])
    top = basis.groupBy(b.col).agg(F.sum(F.col("v") * F.element_at(by, F.col("step"))).alias("v"))
    return values[::-1], Tensor((b,), top)
