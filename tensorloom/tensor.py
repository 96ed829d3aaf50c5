"""Tensors as DataFrames.

coo:     the axes' columns and v (a number, or a struct of re and im, in blocks too); absent means zero
block:   the prefix axes' columns and blk, the dense tail column-major
aliased: the prefix axes' columns, tid and alpha; templates has (tid, blk); a block is alpha times its template
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tensorloom.functions import blocks as B
from tensorloom.meta import Axis, check_permutation, fused, merge_groups, size, split_bra_ket


RESERVED = {"v", "blk", "tid", "alpha"}


@dataclass(frozen=True)
class Tensor:
    axes: tuple[Axis, ...]
    df: DataFrame
    n_dense: int = 0
    templates: DataFrame | None = None
    #: the coordinates that the blocks of a df were made of: (df, coo tensor)
    origin: tuple | None = field(default=None, compare=False, repr=False)
    #: about how many rows its entries were made of, where a source knows; large ones are dealt to more tasks than the session's
    rows: int | None = field(default=None, compare=False, repr=False)

    def __post_init__(self):
        cols = [a.col for a in self.axes]
        taken = [c for c in cols if c in RESERVED or c.startswith("__")]
        if taken:
            raise ValueError(f"axes can't be called {taken}: these columns hold values")
        if len(set(cols)) < len(cols):
            raise ValueError(f"two axes share a column in {cols}: number those of one label by `copy`")

    # -- operators

    def __matmul__(self, other: Tensor) -> Tensor:
        """The contraction over shared labels."""
        from tensorloom.operators.contract import contract

        return contract(self, other)

    def __mul__(self, other) -> Tensor:
        from tensorloom.operators.algebra import scaled

        return self @ other if isinstance(other, Tensor) else scaled(self, other)

    __rmul__ = __mul__

    def __add__(self, other: Tensor) -> Tensor:
        from tensorloom.operators.algebra import add

        return add(self, other)

    def __sub__(self, other: Tensor) -> Tensor:
        from tensorloom.operators.algebra import subtract

        return subtract(self, other)

    # -- form

    @property
    def form(self) -> str:
        return "aliased" if self.templates is not None else "block" if "blk" in self.df.columns else "coo"

    @property
    def prefix(self) -> tuple[Axis, ...]:
        return self.axes[: len(self.axes) - self.n_dense]

    @property
    def tail(self) -> tuple[Axis, ...]:
        return self.axes[len(self.axes) - self.n_dense :]

    @property
    def keys(self) -> list[str]:
        return [a.col for a in self.prefix]

    @property
    def dims(self) -> tuple[int, ...]:
        return tuple(a.dim for a in self.axes)

    @property
    def blksize(self) -> int:
        return size(self.tail)

    @property
    def is_complex(self) -> bool:
        return isinstance(self.kind, T.StructType)

    @property
    def kind(self) -> T.DataType:
        """The values' type."""
        if self.form == "coo":
            return self.df.schema["v"].dataType
        return _element(self.df if self.form == "block" else self.templates)

    def as_complex(self) -> Tensor:
        if self.is_complex:
            return self
        whole = lambda x: B.pair(x.cast("double"), F.lit(0.0))
        if self.form == "coo":
            return replace(self, df=self.df.withColumn("v", whole(F.col("v"))))
        if self.form == "block":
            return replace(self, df=self.df.withColumn("blk", F.transform("blk", whole)))
        return replace(self, df=self.df.withColumn("alpha", whole(F.col("alpha"))), templates=self.templates.withColumn("blk", F.transform("blk", whole)))

    def axis(self, name: str) -> Axis:
        return next((a for a in self.axes if a.col == name), None) or next(a for a in self.axes if a.name == name)

    # -- sources

    @classmethod
    def coo(cls, df: DataFrame, axes: list[Axis], v: str | Column = "v", check: bool = False, unique: bool = False) -> Tensor:
        """From rows of coordinates and a value: values at equal coordinates are summed, zeros go. check: refuse repeated or outlying
        coordinates instead. unique: the coordinates are known not to repeat, so nothing is summed."""
        axes = tuple(axes)
        out = df.select(*[F.col(a.col) for a in axes], (F.col(v) if isinstance(v, str) else v).alias("v"))
        made = cls(axes, out)
        if not (check or unique):
            out = out.groupBy(*made.keys).agg(B.total(F.col("v"), made.is_complex).alias("v"))
            return cls(axes, out).pruned()
        if check:
            outside = F.lit(False)
            for a in axes:
                outside |= (F.col(a.col) < 1) | (F.col(a.col) > a.dim)
            # one pass over the entries, which ends at the first fault
            if not out.groupBy(*made.keys).agg(F.count(F.lit(1)).alias("__n"), F.max(outside).alias("__out")).where("__n > 1 or __out").isEmpty():
                raise ValueError("coordinates repeat or lie outside")
        return made.pruned()

    @classmethod
    def load(cls, df: DataFrame, axes: list[Axis], form: str = "coo", dense: list[str] = (), v: str | Column = "v", unique: bool = False) -> Tensor:
        """From rows of coordinates in a format, axes in canonical order: bra sites, ket sites, links, and the dense ones last."""
        bra, ket = split_bra_ket(axes)
        order = [*bra, *ket, *(x for x in axes if x.link)]
        last = [next(x for x in axes if name in (x.col, x.name)) for name in dense]
        out = cls.coo(df, [*(x for x in order if x not in last), *last], v, unique=unique)
        return out.converted(form, len(last))

    def converted(self, form: str, n_dense: int | None = None) -> Tensor:
        n = self.n_dense if n_dense is None else n_dense
        if form == "coo":
            return self.to_coo()
        t = self if self.form != "coo" and self.n_dense == n else self.to_block(n)
        return t.expand() if form == "block" else t.to_aliased()

    @classmethod
    def empty(cls, spark, axes: list[Axis], n_dense: int = 0, form: str = "coo") -> Tensor:
        keys = "".join(f"`{a.col}` int, " for a in axes[: len(axes) - n_dense])
        value = {"coo": "v double", "block": "blk array<double>", "aliased": "tid string, alpha double"}[form]
        templates = spark.createDataFrame([], "tid string, blk array<double>") if form == "aliased" else None
        return cls(tuple(axes), spark.createDataFrame([], keys + value), n_dense, templates)

    @classmethod
    def dense(cls, df: DataFrame, axes: list[Axis], atol: float = 1e-12, rtol: float = 0.0) -> Tensor:
        """From an array with one entry everywhere: entries with abs(v) <= atol + rtol * abs(v) go; complex ones by their modulus."""
        size_ = B.magnitude(F.col("v"), isinstance(df.schema["v"].dataType, T.StructType))
        return cls.coo(df.where(size_ > atol + rtol * size_), axes, unique=True)

    @classmethod
    def from_parquet(cls, spark, path: str, axes: list[Axis], v: str = "v", unique: bool = False) -> Tensor:
        """Only the axes' columns and the value are read. unique: the file was written by to_parquet() or repeats no coordinates."""
        return cls.coo(spark.read.parquet(path), axes, v, unique=unique)

    def to_parquet(self, path: str, partition_by: str | None = None) -> None:
        writer = self.df.write.mode("overwrite")
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)

    def pruned(self) -> Tensor:
        """Canonical form: no zeros."""
        if self.form == "block":
            return replace(self, df=self.df.where(B.nonzero(F.col("blk"), self.is_complex)))
        return replace(self, df=self.df.where(B.present(F.col("v" if self.form == "coo" else "alpha"), self.is_complex)))

    # -- conversions

    def to_coo(self) -> Tensor:
        if self.form == "coo":
            return self
        if self.origin and self.origin[0] is self.df and self.origin[1].axes == self.axes:
            return self.origin[1]
        t = self.expand()
        cells = t.df.select(*t.keys, F.posexplode("blk").alias("__pos", "v")).where(B.present(F.col("v"), t.is_complex))
        where = B.decode(F.col("__pos"), [a.dim for a in t.tail])
        return Tensor(t.axes, cells.select(*t.keys, *[c.alias(a.col) for c, a in zip(where, t.tail, strict=True)], "v"))

    def to_block(self, n_dense: int, keep: float | None = None, rtol: float = 0.0, all_blocks: bool = False) -> Tensor:
        """The last n_dense axes become blocks; values at equal coordinates are summed. keep, rtol: only blocks stay whose
        largest absolute value is above keep and above rtol times that of the whole tensor. all_blocks: a block for each
        prefix, zeros too. The coordinates are remembered, so that going back costs nothing."""
        t = self.to_coo()
        out = Tensor(t.axes, t.df, n_dense, rows=t.rows)
        z, zero = t.is_complex, B.zero(t.kind)
        pos = B.encode([F.col(a.col) for a in out.tail], [a.dim for a in out.tail], 0)
        cells = t.df.select(*out.keys, pos.alias("__pos"), "v")
        if out.blksize <= B.WIDE:
            blk = F.array(*[F.coalesce(B.total(F.when(F.col("__pos") == i, F.col("v")), z), zero) if not z else B.pair(*[F.coalesce(F.sum(F.when(F.col("__pos") == i, F.col("v")[part])), F.lit(0.0)) for part in ("re", "im")]) for i in range(out.blksize)])
        else:
            cells = cells.groupBy(*out.keys, "__pos").agg(B.total(F.col("v"), z).alias("v"))
            entries = F.map_from_entries(F.collect_list(F.struct("__pos", "v")))
            blk = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(out.blksize - 1).cast("long")), lambda p: F.coalesce(F.element_at(entries, p), zero))
        df = cells.groupBy(*out.keys).agg(blk.alias("blk"))
        if keep is not None or rtol:
            top = F.array_max(F.transform("blk", lambda x: B.magnitude(x, z)))
            if rtol:  # one row
                most = df.agg(F.max(top).alias("__top"))
                df = df.crossJoin(F.broadcast(most)).where(top > rtol * F.col("__top")).drop("__top")
            return replace(out, df=df if keep is None else df.where(top > keep))
        if all_blocks and out.prefix:
            grid = t.df.sparkSession.range(size(out.prefix))
            grid = grid.select(*[c.alias(a.col) for c, a in zip(B.decode(F.col("id"), [a.dim for a in out.prefix]), out.prefix, strict=True)])
            df = grid.join(df, out.keys, "left").select(*out.keys, F.coalesce("blk", F.array_repeat(zero, out.blksize)).alias("blk"))
        return replace(out, df=df, origin=(df, t))

    def to_aliased(self) -> Tensor:
        """Equal blocks share a template."""
        if self.form == "aliased":
            return self
        t = self if self.form == "block" else self.to_block(self.n_dense)
        one = B.number(1, True) if t.is_complex else F.lit(1).cast(t.kind)
        return replace(t, df=t.df.select(*t.keys, B.identity("blk").alias("tid"), one.alias("alpha")), templates=t.df.select(B.identity("blk").alias("tid"), "blk").dropDuplicates(["tid"]))

    def expand(self) -> Tensor:
        """Aliased to block."""
        if self.form != "aliased":
            return self
        df = self.df.join(self.templates, "tid").select(*self.keys, B.scale(F.col("blk"), F.col("alpha"), self.is_complex).alias("blk"))
        return replace(self, df=df, templates=None)

    def to_dense(self, fill: complex = 0, merges: list[tuple[str, str]] | None = None) -> DataFrame:
        """All coordinates, absent ones with `fill`. merges: pairs of axes that become one; None merges links of one label."""
        t = self.to_coo()
        groups = [[t.axes[i].col for i in g] for g in merge_groups(t.axes)] if merges is None else merges
        for first, *rest in groups:
            for other in rest:
                x, y = t.axis(first), t.axis(other)
                t = t.fuse(first, other, x.name)
                first = fused(x, y, x.name).col  # noqa: PLW2901
        grid = t.df.sparkSession.range(size(t.axes)).select(*[c.alias(a.col) for c, a in zip(B.decode(F.col("id"), list(t.dims)), t.axes, strict=True)])
        absent = B.number(fill, True) if t.is_complex else F.lit(fill).cast(t.kind)
        return grid.join(t.df, [a.col for a in t.axes], "left").withColumn("v", F.coalesce("v", absent))

    def merged(self, keep: str, other: str) -> Tensor:
        """Two axes as one: keep + (other - 1) * dim(keep)."""
        return self.to_coo().fuse(keep, other)

    def diagonal(self, label: str, plev: int = 0) -> Tensor:
        """Entries whose coordinates on all axes of this label are equal, with one axis of it left."""
        t = self.to_coo()
        first, *rest = [a for a in t.axes if a.label == (label, plev)]
        if any(a.dim != first.dim for a in rest):
            raise ValueError("axes of one label differ in dimension")
        equal = F.lit(True)
        for a in rest:
            equal &= F.col(a.col) == F.col(first.col)
        kept, one = [a for a in t.axes if a not in rest], replace(first, copy=0)
        cols = [F.col(a.col).alias(one.col if a == first else a.col) for a in kept]
        return Tensor(tuple(one if a == first else a for a in kept), t.df.where(equal).select(*cols, "v"))

    def trace(self, label: str, plev: int = 0) -> Tensor:
        """The sum over equal coordinates of all axes of this label, which go."""
        t = self.diagonal(label, plev)
        axes = tuple(a for a in t.axes if a.label != (label, plev))
        if not axes:
            return Tensor((), _one_row(t.df, t.kind))
        return Tensor(axes, t.df.groupBy(*[a.col for a in axes]).agg(B.total(F.col("v"), t.is_complex).alias("v"))).pruned()

    # -- point access

    def get(self, **at: int) -> DataFrame:
        """One row with the value at a coordinate, zero where nothing is stored."""
        hit = F.lit(True)
        for a in self.prefix:
            hit &= F.col(a.col) == at[a.col]
        rows, zero = self.df.where(hit), B.zero(self.kind)
        if self.form == "coo":
            return _one_row(rows, self.kind)
        place = int(sum((at[a.col] - 1) * s for a, s in zip(self.tail, _strides(self.tail), strict=True)))
        value = F.get("blk", F.lit(place))
        if self.form == "aliased":
            rows, value = rows.join(self.templates, "tid"), B.mul(value, F.col("alpha"), self.is_complex)
        return rows.agg(F.coalesce(F.max(value), zero).alias("v"))

    def upsert(self, entries: DataFrame) -> Tensor:
        """Entries replace those at their coordinates; zero deletes; entries that repeat coordinates are summed first. Of a block
        tensor only the blocks they touch are remade."""
        if self.form == "coo":
            cols = [a.col for a in self.axes]
            entries = entries.groupBy(*cols).agg(B.total(F.col("v"), self.is_complex).alias("v"))
            return Tensor(self.axes, self.df.join(entries, cols, "left_anti").unionByName(entries.select(*cols, "v"))).pruned()
        t = self.expand()
        if not t.keys:
            return t.to_coo().upsert(entries).to_block(t.n_dense)
        touched = entries.select(*t.keys).distinct()
        made = replace(t, df=t.df.join(touched, t.keys, "left_semi")).to_coo().upsert(entries).to_block(t.n_dense)
        return replace(t, df=t.df.join(touched, t.keys, "left_anti").unionByName(made.df))

    # -- layout

    def permute(self, names: list[str], strict: bool = False) -> Tensor:
        """Axes in another order. In blocks an axis may cross between prefix and tail through coordinates, unless strict."""
        axes = tuple(self.axis(n) for n in names)
        check_permutation([self.axes.index(a) for a in axes], len(self.axes))
        if not self.n_dense:
            return replace(self, axes=axes, df=self.df.select(*[a.col for a in axes], *[c for c in self.df.columns if c in ("v", "blk", "tid", "alpha")]))
        tail = axes[len(axes) - self.n_dense :]
        if {a.label for a in tail} != {a.label for a in self.tail}:
            if strict:
                raise ValueError("an axis crosses between prefix and tail")
            return self.to_coo().permute(names).to_block(self.n_dense)
        moved = B.permute(F.col("blk"), [a.dim for a in self.tail], [self.tail.index(a) for a in tail])
        keys = [a.col for a in axes[: len(axes) - self.n_dense]]
        if self.form == "aliased":  # templates only
            return replace(self, axes=axes, df=self.df.select(*keys, "tid", "alpha"), templates=self.templates.select("tid", moved.alias("blk")))
        return replace(self, axes=axes, df=self.df.select(*keys, moved.alias("blk")))

    def fuse(self, a: str, b: str, name: str | None = None, strict: bool = False) -> Tensor:
        """Two axes as one, a fast: (b - 1) * dim(a) + a, in the place of a."""
        x, y = self.axis(a), self.axis(b)
        both = fused(x, y, name)
        inside = [q for q in (x, y) if q in self.tail]
        if len(inside) == 1:
            if strict:
                raise ValueError("an axis of the prefix can't be fused with one of the tail")
            return self.to_coo().fuse(a, b, name)
        if inside:
            order = [q.col for q in self.axes if q != y]
            order.insert(order.index(x.col) + 1, y.col)
            t = self.permute(order)
            return replace(t, axes=tuple(both if q == x else q for q in t.axes if q != y), n_dense=t.n_dense - 1)
        df = self.df.withColumn("__f", ((F.col(y.col) - 1) * x.dim + F.col(x.col)).cast("int")).drop(x.col, y.col).withColumnRenamed("__f", both.col)
        axes = tuple(both if q == x else q for q in self.axes if q != y)
        keys = [q.col for q in axes[: len(axes) - self.n_dense]]
        return replace(self, axes=axes, df=df.select(*keys, *[c for c in df.columns if c not in keys]))

    def relabel(self, change) -> Tensor:
        """change: Axis -> Axis, of the same dimensions."""
        new = tuple(map(change, self.axes))
        if len({(a.label, a.copy) for a in new}) < len(new):
            raise ValueError("two axes would share a label")
        renamed = [F.col(o.col).alias(n.col) for o, n in zip(self.prefix, new, strict=False)]  # at once, so labels may be swapped
        return replace(self, axes=new, df=self.df.select(*renamed, *[c for c in self.df.columns if c not in self.keys]))

    def prime(self, by: int = 1, names: list[str] | None = None) -> Tensor:
        return self.relabel(lambda a: a.primed(a.plev + by) if names is None or a.name in names else a)

    def noprime(self) -> Tensor:
        return self.relabel(lambda a: a.primed(0))

    def setprime(self, to: int, names: list[str] | None = None) -> Tensor:
        return self.relabel(lambda a: a.primed(to) if names is None or a.name in names else a)

    def replaceprime(self, old: int, new: int) -> Tensor:
        return self.relabel(lambda a: a.primed(new) if a.plev == old else a)

    def rename(self, old: str, new: str) -> Tensor:
        return self.relabel(lambda a: replace(a, name=new) if old in (a.name, a.col) else a)

    def rekey(self, kind: str) -> Tensor:
        """Key columns of another integer type; values outside it are an error."""
        most = {"byte": 127, "short": 32767, "int": 2**31 - 1, "long": 2**63 - 1}[kind]
        if any(a.dim > most for a in self.prefix):
            raise ValueError(f"a dimension is beyond {kind}")
        for a in self.prefix:  # values beyond it are an error even where the dimension is right
            inside = F.assert_true(F.col(a.col).between(1, most), f"{a.col} is beyond {kind}")
            self = replace(self, df=self.df.withColumn(a.col, F.when(inside.isNull(), F.col(a.col).cast(kind))))  # noqa: PLW0642
        return self

    def retype(self, kind: str) -> Tensor:
        """Values of another type; a value that the type can't hold exactly is an error."""
        if self.is_complex:
            raise ValueError("complex values can't be cast to a real type")

        def held(v: Column) -> Column:
            cast = v.try_cast(kind)
            same = F.assert_true(F.coalesce(cast.cast(self.kind) == v, F.lit(False)), "a value can't be held exactly")
            return F.when(same.isNull(), cast)

        if self.form == "coo":
            return replace(self, df=self.df.withColumn("v", held(F.col("v"))))
        t = self.expand()
        return replace(t, df=t.df.withColumn("blk", F.transform("blk", held)))

    def narrowed(self) -> Tensor:
        """Whole numbers held as decimals, as 64-bit integers where all of them fit; else the decimals stay, so that none is cut. Runs
        the tensor once, so it is for results that are written first or small."""
        inside = F.coalesce(F.bool_and(F.col("v").between(-(2**63), 2**63 - 1)), F.lit(True))
        return replace(self, df=self.df.withColumn("v", F.col("v").cast("long"))) if self.df.agg(inside).first()[0] else self

    def sorted(self, order: list[str | Column] | None = None) -> DataFrame:
        """Rows in canonical order, the last axis the most significant, or in an order of one's own."""
        return self.df.orderBy(*(order or reversed(self.keys)))

    def describe(self) -> DataFrame:
        """Stored entries against the dense size, in one row."""
        n = F.count(F.lit(1)) * (self.blksize if self.n_dense else 1)
        return self.df.agg(n.alias("stored"), F.lit(size(self.axes)).cast("long").alias("dense"))

    def is_dense(self) -> bool:
        return self.df.count() == size(self.prefix)


def made_of(*tensors: Tensor) -> int | None:
    return max((t.rows for t in tensors if t.rows), default=None)


def _one_row(df: DataFrame, kind) -> DataFrame:
    """The sum of v in one row, zero where there is none."""
    zero = B.zero(kind)
    if isinstance(kind, T.StructType):
        return df.agg(B.pair(F.coalesce(F.sum("v.re"), zero["re"]), F.coalesce(F.sum("v.im"), zero["im"])).alias("v"))
    return df.agg(F.coalesce(F.sum("v"), zero).alias("v"))


def _strides(axes):
    from tensorloom.meta import strides

    return strides([a.dim for a in axes])


def _element(df: DataFrame):
    return df.schema["blk"].dataType.elementType
