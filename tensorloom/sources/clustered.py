"""Tensors stored so that near coordinates share files, with each file's coordinate ranges: lookups and slices open few files."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tensorloom.meta import Axis
from tensorloom.sources.shared import written
from tensorloom.tensor import Tensor


def morton(cols: list[str], highest: list[int]) -> Column:
    """The bits of the coordinates by turns, those of the highest order first; each axis fills the same number of bits."""
    bits = min(31, 62 // len(cols))
    out = F.lit(0).cast("long")
    for place, (c, top) in enumerate(zip(cols, highest, strict=True)):
        width = max(1, (top - 1).bit_length())
        at = F.col(c).cast("long") - 1
        at = F.shiftright(at, width - bits) if width > bits else F.shiftleft(at, bits - width)
        for b in range(max(0, bits - width), bits):  # lower bits are 0
            out = out.bitwiseOR(F.shiftleft(F.shiftright(at, b).bitwiseAND(F.lit(1).cast("long")), b * len(cols) + place))
    return out


@dataclass(frozen=True)
class Clustered:
    """`data` and `ranges` below a path that all executors share. A write counts once `ranges` is committed; a folder is written once."""

    spark: SparkSession
    path: str
    axes: tuple[Axis, ...]
    n_dense: int
    by: tuple[str, ...]

    @classmethod
    def write(cls, t: Tensor, path: str, by: list[str] | None = None, rows: int = 4_000_000) -> Clustered:
        """Coordinates or blocks in files of about `rows` rows, by the space-filling order of some of the sparse axes (all by default).

        The tensor is computed once; then its keys are read for the highest coordinates and for the ranges of the sort, and all of
        it for the sorted files. Rows that share a place in that order are told apart by all their keys, so a hot coordinate
        takes several files.
        """
        if t.form == "aliased":
            raise ValueError("aliased tensors are stored expanded")
        by = list(by or t.keys)
        if not by or not set(by) <= set(t.keys):
            raise ValueError(f"a tensor is clustered by some of its sparse axes {t.keys}")
        path, spark = path.rstrip("/"), t.df.sparkSession
        df = written(t.df, "unclustered")
        found = df.agg(F.count(F.lit(1)).alias("__n"), *[F.max(c).alias(c) for c in by]).first()
        place = morton(by, [int(found[c] or 1) for c in by])
        files = max(1, -(-found["__n"] // rows))
        ordered = df.repartitionByRange(files, place, F.xxhash64(*t.keys)).sortWithinPartitions(place)
        ordered.write.option("maxRecordsPerFile", 2 * rows).parquet(f"{path}/data")
        keys = spark.read.schema(df.schema).parquet(f"{path}/data").select(*by, F.col("_metadata.file_path").alias("__file"))
        ends = [f(c).alias(f"{c}__{n}") for c in by for n, f in (("low", F.min), ("high", F.max))]
        keys.groupBy("__file").agg(*ends).coalesce(1).write.parquet(f"{path}/ranges")  # a row a file
        return cls(spark, path, t.axes, t.n_dense, tuple(by))

    def _condition(self, at: dict, low: str, high: str) -> Column:
        out = F.lit(True)
        for c, want in at.items():
            first, last = want if isinstance(want, tuple) else (want, want)
            out &= (F.col(c + high) >= first) & (F.col(c + low) <= last)
        return out

    def files(self, **at: int | tuple[int, int]) -> list[str]:
        """The files that may hold these coordinates: a list on the driver, as a scan itself has of all files it opens."""
        ranges = self.spark.read.parquet(f"{self.path}/ranges")
        inside = {c: want for c, want in at.items() if c in self.by}
        return sorted(r[0] for r in ranges.where(self._condition(inside, "__low", "__high")).select("__file").collect())

    def read(self, **at: int | tuple[int, int]) -> Tensor:
        """The entries or blocks at these coordinates: axis=number or axis=(first, last). Axes it isn't clustered by, dense ones
        excepted, may be given too; they skip no files."""
        keys = [a.col for a in self.axes[: len(self.axes) - self.n_dense]]
        if not set(at) <= set(keys):
            raise ValueError(f"coordinates are given on some of {keys}")
        data = self.spark.read.parquet(f"{self.path}/data")
        files = self.files(**at)
        df: DataFrame = self.spark.read.schema(data.schema).parquet(*files).where(self._condition(at, "", "")) if files else data.where("false")
        return Tensor(self.axes, df, self.n_dense)
