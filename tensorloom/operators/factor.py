"""Factorizations. The linear algebra of one sector runs in NumPy inside a grouped Arrow function; ranking and truncation over
all sectors are Spark sorts."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tensorloom.functions import blocks as B
from tensorloom.functions.order import numbered
from tensorloom.meta import Axis
from tensorloom.operators.algebra import conjugate
from tensorloom.operators.contract import contract
from tensorloom.operators.meet import dealt
from tensorloom.operators.reduce import norm
from tensorloom.sources.shared import written
from tensorloom.tensor import Tensor

FAN = 16


def _apart(c: str, z: bool, array: bool = False) -> list[Column]:
    """A column as it goes to Python: complex numbers as two columns of real ones."""
    part = lambda name: F.transform(c, lambda x: x[name]) if array else F.col(c)[name]
    return [part("re").alias(c), part("im").alias(f"{c}_im")] if z else [F.col(c)]


def _numbers(pdf: pd.DataFrame, z: bool) -> np.ndarray:
    return pdf["v"].to_numpy(float) + 1j * pdf["v_im"].to_numpy(float) if z else pdf["v"].to_numpy(float)


def _back(c: str, z: bool) -> Column:
    """The array column that _vectors made of rows."""
    return (F.zip_with(c, f"{c}_im", B.pair) if z else F.col(c)).alias(c)


def _vectors(name: str, rows: np.ndarray, z: bool) -> dict[str, list]:
    return {name: list(rows.real), f"{name}_im": list(rows.imag)} if z else {name: list(rows)}


def _vector_schema(z: bool, *names: str) -> str:
    return ", ".join(f"{n}{end} array<double>" for n in names for end in (("", "_im") if z else ("",)))


def _phases(x: np.ndarray) -> np.ndarray:
    """What turns each number real and positive; 1 for zeros."""
    size = np.abs(x)
    return np.where(size > 0, np.conj(x) / np.where(size > 0, size, 1), 1)


def _svd(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Thin SVD whose left vectors have a positive largest entry."""
    u, s, vt = np.linalg.svd(m, full_matrices=False)
    phase = _phases(u[np.abs(u).argmax(axis=0), np.arange(u.shape[1])])
    return u * phase, s, vt * np.conj(phase)[:, None]


def _matrix(pdf: pd.DataFrame, row: str, col: str, z: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows, i = np.unique(pdf[row], return_inverse=True)
    cols, j = np.unique(pdf[col], return_inverse=True)
    m = np.zeros((len(rows), len(cols)), complex if z else float)
    np.add.at(m, (i, j), _numbers(pdf, z))
    return m, rows, cols


def sector_svd(t: Tensor, sector: str, row: str, col: str, stable: bool = False) -> DataFrame:
    """(sector, k, sv, u, vt, rows, cols): the thin SVD of each sector's matrix, signs or phases fixed by the largest
    entry of u, which is positive. stable: by stable_svd, so that equal values have fixed vectors. A sector is one task's;
    spectral.full_svd takes matrices that are too large for that."""
    z, t = t.is_complex, t.to_coo()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        m, rows, cols = _matrix(pdf, row, col, z)
        u, s, vt = stable_svd(m) if stable else _svd(m)
        one = pdf[sector].iloc[0]
        return pd.DataFrame({sector: one, "k": np.arange(1, len(s) + 1), "sv": s, **_vectors("u", u.T, z), **_vectors("vt", vt, z), "rows": [rows.tolist()] * len(s), "cols": [cols.tolist()] * len(s)})

    kind = t.df.schema[sector].dataType.simpleString()
    schema = f"{sector} {kind}, k int, sv double, {_vector_schema(z, 'u', 'vt')}, rows array<long>, cols array<long>"
    made = t.df.select(sector, row, col, *_apart("v", z)).groupBy(sector).applyInPandas(run, schema)
    return made.select(sector, "k", "sv", _back("u", z), _back("vt", z), "rows", "cols")


def truncate(values: DataFrame, sector: str, cutoff: float = 0.0, maxdim: int | None = None, mindim: int = 1) -> tuple[DataFrame, DataFrame]:
    """Keep singular values over all sectors: the largest maxdim, less those below cutoff * largest as long as more than mindim
    are left. Returns the kept rows with their number and each sector's offset, and one row with the discarded weight."""
    ranked = numbered(values, [F.desc("sv"), F.col(sector), F.col("k")], "rank").withColumn("rank", F.col("rank").cast("int"))
    top = values.agg(F.max("sv").alias("__top"))  # one row
    keep = (F.col("rank") <= (maxdim or 2**31 - 1)) & ((F.col("rank") <= mindim) | (F.col("sv") >= cutoff * F.col("__top")))
    marked = ranked.crossJoin(F.broadcast(top)).withColumn("keep", keep).drop("__top")
    kept = marked.where("keep").drop("keep")
    first = numbered(kept.select(sector, "k"), [F.col(sector), F.col("k")], "__n").groupBy(sector).agg((F.min("__n") - 1).alias("offset"))
    return kept.join(first, sector), marked.agg(F.coalesce(F.sum(F.when(~F.col("keep"), F.col("sv") * F.col("sv"))), F.lit(0.0)).alias("discarded"))


def _numbered(made: DataFrame, sector: str, cutoff: float, maxdim: int | None, mindim: int, bond: str) -> tuple[DataFrame, DataFrame]:
    """The rows of made that stay after truncation, with their number in the bond, and one row with the discarded weight."""
    kept, discarded = truncate(made.select(sector, "k", "sv"), sector, cutoff, maxdim, mindim)
    kept = written(kept.select(sector, "k", (F.col("offset") + F.col("k")).cast("int").alias(bond)), "numbers")
    return made.join(kept, [sector, "k"]), discarded


def _sector_left(t: Tensor) -> DataFrame:
    """(sector, k, sv, u) of a block tensor (sector, r ; s, q): the left vectors and singular values of each sector's blocks side by
    side, from triangles of at most s x s numbers: of the blocks in a batch, of FAN groups of tasks, of all."""
    (left, _), (s, _), z = t.prefix, t.tail, t.is_complex
    sector, number = left.col, complex if z else float
    kind = t.df.schema[sector].dataType.simpleString()

    def triangle(name, rows: np.ndarray) -> dict:
        return {sector: name, "r": np.linalg.qr(rows, mode="r").astype(number).tobytes()}

    def blocks(batches):
        for pdf in batches:
            made = []
            for name, some in pdf.groupby(sector):
                flat = lambda c: np.concatenate([np.asarray(b, float) for b in some[c]]).reshape(-1, s.dim)  # noqa: B023, E731
                made.append(triangle(name, flat("blk") + 1j * flat("blk_im") if z else flat("blk")))
            yield pd.DataFrame(made, columns=[sector, "r"])

    def stacked(pdf: pd.DataFrame) -> np.ndarray:
        return np.vstack([np.frombuffer(r, number).reshape(-1, s.dim) for r in pdf["r"]])

    def together(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([triangle(pdf[sector].iloc[0], stacked(pdf))])

    def last(pdf: pd.DataFrame) -> pd.DataFrame:
        u, values, _ = _svd(np.linalg.qr(stacked(pdf), mode="r").T)
        return pd.DataFrame({sector: pdf[sector].iloc[0], "k": np.arange(1, len(values) + 1), "sv": values, **_vectors("u", u.T, z)})

    schema = f"{sector} {kind}, r binary"
    rows = t.expand().df.select(sector, *_apart("blk", z, array=True)).mapInPandas(blocks, schema)
    rows = rows.groupBy(sector, (F.spark_partition_id() % FAN).alias("part")).applyInPandas(together, schema)
    made = rows.groupBy(sector).applyInPandas(last, f"{sector} {kind}, k int, sv double, {_vector_schema(z, 'u')}")
    return made.select(sector, "k", "sv", _back("u", z))


def block_svd(t: Tensor, cutoff: float = 0.0, maxdim: int | None = None, mindim: int = 1, ortho: str = "left", bond: str = "bond") -> tuple[Tensor, Tensor, DataFrame, DataFrame]:
    """Factors of a block tensor (l, r ; s, t): u (l, bond ; s) and w (bond, r ; t) with u w = t but for what is truncated.

    Each l is a sector, whose blocks stand side by side as one matrix. With ortho "left" a sector is spread over tasks: u and the
    values come from a tree of QR steps, and w is u* times each block. Else a sector is one task's. Singular values are truncated over all sectors, and the
    kept columns of a sector lie next to each other in the new bond. ortho: the side without them ("left": w has the values,
    "right": u, else neither). Also returns (bond, sv) and one row with the discarded weight.
    """
    (left, right), (s, q), z = t.prefix, t.tail, t.is_complex
    one = lambda c: B.pair(c, F.lit(0.0)) if z else c
    if ortho == "left":
        made = written(_sector_left(t), "sectors")
        parts, discarded = _numbered(made, left.col, cutoff, maxdim, mindim, bond)
        parts = written(parts, "kept")  # as many rows as the bond is long
        axis = Axis(bond, max(1, parts.count()), link=True)
        u = Tensor((left, axis, s), parts.select(left.col, bond, F.col("u").alias("blk")), 1)
        return u, contract(conjugate(u), t.expand(), plan="block"), parts.select(bond, "sv"), discarded

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(right.col)
        whole = lambda c: np.concatenate([np.asarray(b, float).reshape(q.dim, s.dim).T for b in pdf[c]], axis=1)
        u, values, vt = _svd(whole("blk") + 1j * whole("blk_im") if z else whole("blk"))
        k = len(values)
        return pd.DataFrame({left.col: pdf[left.col].iloc[0], "k": np.arange(1, k + 1), "sv": values, **_vectors("u", u.T, z), **_vectors("vt", vt, z), "rs": [pdf[right.col].tolist()] * k})

    kind = dict(t.df.dtypes)
    schema = f"{left.col} {kind[left.col]}, k int, sv double, {_vector_schema(z, 'u', 'vt')}, rs array<long>"
    whole = t.expand().df.select(*t.keys, *_apart("blk", z, array=True))
    made = written(whole.groupBy(left.col).applyInPandas(run, schema).select(left.col, "k", "sv", _back("u", z), _back("vt", z), "rs"), "sectors")
    parts, discarded = _numbered(made, left.col, cutoff, maxdim, mindim, bond)
    sv = lambda side: one(F.lit(1.0) if side else F.col("sv"))
    u = parts.select(left.col, bond, B.scale(F.col("u"), sv(ortho != "right"), z).alias("blk"))
    cut = F.slice("vt", F.col("__i") * q.dim + 1, q.dim)
    w = parts.select(bond, "vt", "sv", F.posexplode("rs").alias("__i", right.col)).select(bond, F.col(right.col).cast(kind[right.col]), B.scale(cut, sv(ortho != "left"), z).alias("blk"))
    axis = Axis(bond, max(1, parts.count()), link=True)
    return Tensor((left, axis, s), u, 1), Tensor((axis, right, q), w, 1), parts.select(bond, "sv"), discarded


def _dense(head: list[str], col: str, cols: np.ndarray, z: bool, numbers: int = 1 << 20):
    """Batches of entries sorted by head -> (head..., blk): a row of all columns for each head, complex numbers as two. A head's entries
    are summed, also across batches."""
    n = len(cols)

    def rows(t: pa.Table, starts: np.ndarray):
        step = max(1, numbers // n)
        ends = np.append(starts, t.num_rows)
        for at in range(0, len(starts), step):
            cut = ends[at : at + step + 1]
            some = t.slice(cut[0], cut[-1] - cut[0])
            v = some.column("v").to_numpy().astype(float)
            m = np.zeros((len(cut) - 1, n), complex if z else float)
            place = np.searchsorted(cols, some.column(col).to_numpy())
            np.add.at(m, (np.repeat(np.arange(len(m)), np.diff(cut)), place), v + 1j * some.column("v_im").to_numpy() if z else v)
            yield _blocks_of([t.column(c).combine_chunks().take(pa.array(cut[:-1])) for c in head], head, m)

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            t = (t if held is None else pa.concat_tables([held, t])).combine_chunks()
            new = np.ones(t.num_rows, bool)
            new[1:] = False
            for c in head:
                x = t.column(c).combine_chunks()
                new[1:] |= pc.fill_null(pc.not_equal(x.slice(1), x.slice(0, len(x) - 1)), True).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(new)
            held = t.slice(starts[-1])  # the last head may go on in the next batch
            if len(starts) > 1:
                yield from rows(t.slice(0, starts[-1]), starts[:-1])
        if held is not None:
            yield from rows(held.combine_chunks(), np.zeros(1, np.int64))

    return run


def _blocks_of(keys: list, names: list[str], m: np.ndarray) -> pa.RecordBatch:
    flat = np.ascontiguousarray(m).view(float)
    ends = np.arange(len(m) + 1, dtype=np.int32) * flat.shape[1]
    return pa.RecordBatch.from_arrays([*keys, pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.ravel()))], [*names, "blk"])


def _rows_in(batch: pa.RecordBatch, z: bool) -> np.ndarray:
    flat = batch.column("blk").flatten().to_numpy(zero_copy_only=False).astype(float)
    m = flat.reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, 0))
    return m.view(complex) if z else m


def qr_rows(t: Tensor, head: list[str], col: str, tol: float = 1e-12) -> tuple[DataFrame, np.ndarray, np.ndarray] | None:
    """Thin QR of the matrix (head) x (col): (head..., blk) with the rows of Q, complex numbers as two; R; and the columns' names. None
    without entries.

    A row of the matrix is an array in one row of a table, which is written once; blocks along col alone have that form already. Only
    triangles of col x col numbers move, and FAN of them reach the driver. Others' entries are dealt to tasks by head, a task for
    each ROWS of them where the session has fewer.
    """
    z = t.is_complex
    number = complex if z else float
    kinds = dict(t.df.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in head) + ", blk array<double>"
    if t.form == "block" and [a.col for a in t.tail] == [col] and set(t.keys) == set(head) and not z:
        cols = np.arange(1, t.blksize + 1)
        entry = lambda i: F.coalesce(F.get("blk", i), F.lit(0.0)).cast("double")
        dense = t.df.where("blk is not null").select(*head, F.transform(F.sequence(F.lit(0), F.lit(t.blksize - 1)), entry).alias("blk"))
    else:
        coo = t.to_coo().df
        found = sorted((r[col], r["count"]) for r in coo.groupBy(col).count().collect())  # a row for each column
        cols = np.array([c for c, _ in found])
        if not found:
            return None
        entries = dealt(coo.select(*head, col, *_apart("v", z)).repartition(*head), head, sum(c for _, c in found))
        dense = entries.sortWithinPartitions(*head).mapInArrow(_dense(head, col, cols, z), schema)
    dense = written(dense, "rows")
    n = len(cols)

    def triangle(r: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([np.linalg.qr(r, mode="r").astype(number).tobytes()], pa.binary())], ["r"])

    def first(batches):
        held = np.zeros((0, n), number)
        for batch in batches:
            if batch.num_rows:
                held = np.linalg.qr(np.vstack([held, _rows_in(batch, z)]), mode="r")
        if len(held):
            yield triangle(held)

    def together(batches):
        held = np.zeros((0, n), number)
        for batch in batches:
            held = np.linalg.qr(np.vstack([held, *(np.frombuffer(r, number).reshape(-1, n) for r in batch.column("r").to_pylist())]), mode="r")
        if len(held):
            yield triangle(held)

    tops = dense.select("blk").mapInArrow(first, "r binary").repartition(FAN).mapInArrow(together, "r binary").collect()  # at most FAN triangles
    whole = np.vstack([np.zeros((0, n), number), *(np.frombuffer(bytes(x.r), number).reshape(-1, n) for x in tops)])
    some = np.flatnonzero(np.abs(whole).max(axis=0, initial=0))  # columns without entries go
    if not len(some):
        return None
    _, s, vt = np.linalg.svd(whole[:, some], full_matrices=False)
    rank = max(1, int((s > tol * s[0]).sum()))
    turn, r = np.linalg.qr(s[:rank, None] * vt[:rank])
    lead = np.abs(r) > tol * s[0]
    phase = _phases(r[np.arange(rank), lead.argmax(axis=1)])
    r, into = r * phase[:, None], np.conj(vt[:rank].T) / s[:rank] @ turn * np.conj(phase)

    def turned(batches):
        for batch in batches:
            if batch.num_rows:
                yield _blocks_of([batch.column(c) for c in head], head, _rows_in(batch, z)[:, some] @ into)

    return dense.mapInArrow(turned, schema), r, cols[some]


def left_qr(t: Tensor, head: list[str], col: str, tol: float = 1e-12) -> tuple[DataFrame, DataFrame]:
    """Thin QR of the matrix (head) x (col) by a tree: tasks factorize their rows, and triangles of some tasks together; see qr_rows.

    Q (head, q, v) has as many columns as the matrix has rank, up to tol times the largest singular value, so dependent columns
    do no harm. R (q, col, v) is upper triangular, or in steps below full rank, with positive leading entries. The number of columns
    must be small.
    """
    z, spark = t.is_complex, t.df.sparkSession
    found = qr_rows(t, head, col, tol)
    if found is None:
        empty = t.to_coo().df.limit(0)
        return empty.select(*head, F.lit(0).alias("q"), "v"), empty.select(F.lit(0).alias("q"), col, "v")
    rows, r, cols = found
    kind = dict(t.to_coo().df.dtypes)[col]
    entries = [(j + 1, int(c), float(x.real), float(x.imag)) for j, row in enumerate(r) for c, x in zip(cols, row, strict=True) if x]
    made = spark.createDataFrame(entries, f"q int, {col} {kind}, re double, im double")
    value = lambda at: B.pair(F.get("blk", at * 2), F.get("blk", at * 2 + 1)) if z else F.get("blk", at)
    q = rows.select(*head, "blk", F.explode(F.sequence(F.lit(1), F.lit(len(r)))).alias("q")).select(*head, "q", value(F.col("q") - 1).alias("v"))
    return q, made.select("q", col, (B.pair(F.col("re"), F.col("im")) if z else F.col("re")).alias("v"))


def runs_of_equals(values: np.ndarray, tol: float) -> list[tuple[int, int]]:
    """Stretches of falling values that lie within tol of their first."""
    out, start = [], 0
    for end in range(1, len(values) + 1):
        if end == len(values) or values[start] - values[end] > tol:
            out.append((start, end))
            start = end
    return out


def fixed_basis(inner: list[np.ndarray], gap: float = 1e-10) -> np.ndarray:
    """Eigenvectors of the first matrix whose eigenvalues lie apart, else of the last."""
    for m in inner:
        values, vectors = np.linalg.eigh((m + m.conj().T) / 2)
        if np.diff(values).min(initial=np.inf) > gap * max(1.0, np.abs(values).max()):
            break
    return vectors


def stable_svd(m: np.ndarray, tol: float = 1e-9, null: float = 1e-12) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """SVD of one sector whose vectors don't depend on the gauge: inside a group of equal singular values the basis diagonalises a
    weight, the first of three whose eigenvalues lie apart, and each vector's sum of x |x| is positive; values below `null` times
    the largest have zero vectors. spectral.full_svd has the same for distributed matrices."""
    u, s, vt = np.linalg.svd(m, full_matrices=False)
    place = np.arange(1.0, m.shape[0] + 1)
    share = place / (m.shape[0] + 1)
    weights = [place * (1 + share), np.sin(place * 0.7 + 0.3) + share, place**1.3 + np.cos(place * 0.3)]
    for start, end in runs_of_equals(s, tol * max(1.0, s[0] if len(s) else 0)):
        if end - start > 1:
            block = u[:, start:end].copy()
            turn = fixed_basis([block.conj().T @ (w[:, None] * block) for w in weights])
            u[:, start:end] = block @ turn
            vt[start:end] = turn.conj().T @ vt[start:end]
    phase = _phases((np.abs(u) * u).sum(axis=0))
    u, vt = u * phase, vt * np.conj(phase)[:, None]
    dead = s < null * s[0] if len(s) else np.zeros(0, bool)
    u[:, dead], vt[dead] = 0, 0
    return u, s, vt


def power_iteration(t: Tensor, row: str, col: str, rounds: int = 20) -> float:
    """Estimate of the operator norm of a square matrix. Each round's vector is written, so the plan doesn't grow and no vector reaches the driver."""
    a, b = t.axis(row), t.axis(col)
    spark = t.df.sparkSession
    x = Tensor((b,), spark.range(1, b.dim + 1).select(F.col("id").cast("int").alias(b.col), F.lit(1.0).alias("v")))
    length = 0.0
    for _ in range(rounds):
        y = contract(t, x)
        length = norm(y).first()[0]
        if not length:
            return 0.0
        v = B.pair(F.col("v.re") / length, F.col("v.im") / length) if y.is_complex else F.col("v") / length
        x = Tensor((b,), written(y.df.select(F.col(a.col).alias(b.col), v.alias("v")), "vector"))
    return length


def _inner(t: Tensor) -> DataFrame:
    """(i, j, g): inner products of the columns that the blocks are rows of; of columns that hold anything, as coordinates are."""
    n = t.blksize

    def sums(batches):
        held = np.zeros((n, n))
        for batch in batches:
            x = batch.column("blk").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, n)
            held += x.T @ x
        i, j = np.divmod(np.arange(n * n), n)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(held.ravel())], ["i", "j", "g"])

    gram = t.df.select("blk").mapInArrow(sums, "i int, j int, g double").groupBy("i", "j").agg(F.sum("g").alias("g"))
    some = gram.where("i = j and g <> 0").select("i")  # a row for each column
    return gram.join(F.broadcast(some), "i").join(F.broadcast(some.withColumnRenamed("i", "j")), "j")


def isometry_defect(t: Tensor, head: list[str], col: str) -> DataFrame:
    """Largest absolute entry of P*P - 1, one row; P* is the conjugate transpose. Real blocks along col alone are rows: their inner
    products are summed in each task."""
    if t.form == "block" and [a.col for a in t.tail] == [col] and set(t.keys) == set(head) and not t.is_complex:
        return _inner(t).agg(F.max(F.abs(F.col("g") - F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0))).alias("defect"))
    p, z = t.to_coo().df, t.is_complex
    other = p.select(*head, F.col(col).alias("__c"), F.col("v").alias("__v"))
    turned = B.pair(F.col("v.re"), -F.col("v.im")) if z else F.col("v")
    gram = p.join(other, head).groupBy(col, "__c").agg(B.total(B.mul(turned, F.col("__v"), z), z).alias("g"))
    one = F.when(F.col(col) == F.col("__c"), 1.0).otherwise(0.0)
    apart = B.pair(F.col("g.re") - one, F.col("g.im")) if z else F.col("g") - one
    return gram.agg(F.max(B.magnitude(apart, z)).alias("defect"))
