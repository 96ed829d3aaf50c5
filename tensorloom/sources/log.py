"""A tensor that changes: a base and numbered appends in one folder, merged when read, and compacted now and then."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tensorloom.functions import blocks as B
from tensorloom.meta import Axis
from tensorloom.sources.shared import committed
from tensorloom.tensor import Tensor


@dataclass(frozen=True)
class TensorLog:
    """Folders `base=<n>` (the state after append n) and `append=<n>` below a path that all executors share.

    An append sets values (zero deletes) or adds to them. Entries of one append that share a coordinate are summed first; appends
    follow each other by number. One writer at a time: an append whose number is taken fails. A folder counts once Spark has
    committed it, so a writer that is lost leaves no trace in what is read.
    """

    spark: SparkSession
    path: str
    axes: tuple[Axis, ...]

    @classmethod
    def create(cls, base: Tensor, path: str) -> TensorLog:
        t = base.to_coo()
        log = cls(t.df.sparkSession, path.rstrip("/"), t.axes)
        t.df.write.parquet(log._folder("base", 0))
        return log

    def _folder(self, kind: str, number: int) -> str:
        return f"{self.path}/{kind}={number:08d}"

    def _numbers(self, kind: str) -> list[int]:
        return committed(self.spark, self.path, kind)

    @property
    def version(self) -> int:
        """The number of the last append."""
        return max([*self._numbers("append"), *self._numbers("base")])

    def append(self, entries: DataFrame, how: str = "set") -> int:
        """Entries (axes..., v) that are set or added; returns their number."""
        if how not in ("set", "add"):
            raise ValueError("entries are set or added")
        number = self.version + 1
        cols = [a.col for a in self.axes]
        kind = self._read(self._folder("base", self._numbers("base")[-1])).schema["v"].dataType
        z = kind.simpleString().startswith("struct")
        once = entries.groupBy(*cols).agg(B.total(F.col("v"), z).cast(kind).alias("v"))
        once.withColumn("sets", F.lit(how == "set")).write.parquet(self._folder("append", number))
        return number

    def _read(self, folder: str) -> DataFrame:
        return self.spark.read.parquet(folder)

    def read(self, version: int | None = None) -> Tensor:
        """The tensor after an append, the last one by default.

        Of each coordinate the entries since the base are folded in their order; there is at most one for each append, so what a
        row holds is bounded by the appends since the last compaction.
        """
        last = self.version if version is None else version
        at = [n for n in self._numbers("base") if n <= last]
        if not at or last > self.version:
            raise ValueError(f"there is no version {last}")
        base = self._read(self._folder("base", at[-1]))
        cols = [a.col for a in self.axes]
        appends = [n for n in self._numbers("append") if at[-1] < n <= last]
        if not appends:
            return Tensor(self.axes, base.select(*cols, "v"))
        rows = base.select(*cols, "v", F.lit(True).alias("sets"), F.lit(0).alias("at"))
        for n in appends:
            rows = rows.unionByName(self._read(self._folder("append", n)).withColumn("at", F.lit(n)))
        kind = base.schema["v"].dataType
        z, zero = kind.simpleString().startswith("struct"), B.zero(kind)
        steps = F.array_sort(F.collect_list(F.struct("at", "sets", "v")))
        value = F.aggregate(steps, zero, lambda s, x: F.when(x["sets"], x["v"]).otherwise(B.plus(s, x["v"], z)))
        return Tensor(self.axes, rows.groupBy(*cols).agg(value.alias("v"))).pruned()

    def compact(self) -> int:
        """Write the present state as a base, from which reading starts; earlier versions stay readable."""
        number = self.version
        if number not in self._numbers("base"):
            self.read(number).df.write.parquet(self._folder("base", number))
        return number
