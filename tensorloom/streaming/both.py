"""Contractions of two streams: entries that arrive on either side meet all of the other side's, earlier ones and those of the
same batch, so that each product is emitted once: dA B + A dB + dA dB."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tensorloom.functions import blocks as B
from tensorloom.meta import Axis, output_axes, shared
from tensorloom.sources.shared import committed
from tensorloom.tensor import Tensor, _one_row

#: How both sides are kept: on disk, one store for each partition in place of four, with a bound on each executor's native memory
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.join.stateFormatVersion": "3",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
}

TASKS = 8  # for each core, in which a batch's entries come together by their labels
HELD, PACK = 1 << 20, 4096  # entries that a task gathers at a time, and of a row of state


@contextmanager
def _settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    """The session with these settings; a stream takes a copy of them when it starts."""
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _packs(on: list[str], rest: list[str], held: int, most: int):
    """Batches of entries -> a row for each label and at most `most` of its entries, an array a column; `held` entries are gathered at a time."""

    def packed(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(batches)
        rows = rows.take(pc.sort_indices(rows, [(c, "ascending") for c in on])).combine_chunks()
        n = rows.num_rows
        first = np.zeros(n, bool)
        first[0] = True
        for c in on:
            x = rows.column(c).combine_chunks()
            first[1:] |= pc.not_equal(x.slice(1), x.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(first)
        place = np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))  # of an entry in its label
        cuts = np.flatnonzero(place % most == 0)
        names = pa.array(cuts)
        ends = pa.array(np.append(cuts, n).astype(np.int32))
        lists = [pa.ListArray.from_arrays(ends, rows.column(c).combine_chunks()) for c in rest]
        return pa.RecordBatch.from_arrays([*(rows.column(c).combine_chunks().take(names) for c in on), pa.array((place[cuts] // most).astype(np.int32)), *lists], [*on, "__part", *rest])

    def run(batches):
        some, n = [], 0
        for batch in batches:
            if batch.num_rows:
                some, n = [*some, batch], n + batch.num_rows
            if n >= held:
                yield packed(some)
                some, n = [], 0
        if some:
            yield packed(some)

    return run


def _gathered(t: Tensor, on: list[str], held: int, most: int) -> DataFrame:
    """(on..., __part, arrays of the other columns): the entries of each batch of a stream by their labels, labels dealt over several tasks a core."""
    rest = [c for c in t.df.columns if c not in on]
    kind = lambda c: t.df.schema[c].dataType.simpleString()
    schema = ", ".join(f"`{c}` {kind(c)}" for c in on) + ", __part int" + "".join(f", `{c}` array<{kind(c)}>" for c in rest)
    known = t.df.where(reduce(Column.__and__, [F.col(c).isNotNull() for c in on]))  # others meet nothing
    return known.repartition(TASKS * t.df.sparkSession.sparkContext.defaultParallelism, *on).mapInArrow(_packs(on, rest, held, most), schema)


def product_entries(a: Tensor, b: Tensor, salts: int = 1) -> Tensor:
    """The products of entries of two tensors whose frames are streams, unsummed, over their shared labels.

    Entries add to what is there: a change is an entry with the difference, and coordinates may repeat. Both sides are state,
    since any entry may meet a later one. A batch's entries of a label are one row of state, or one for each PACK of them, for a row
    costs the state store much more than its numbers do. salts: a label's rows of `a` are split over that many tasks, and each row of
    `b` is kept in all of them.
    """
    if (a.form, b.form) != ("coo", "coo"):
        raise ValueError("streams are contracted by coordinates")
    common = [x.col for x in shared(a.axes, b.axes)]
    if not common:
        raise ValueError("streams without a shared label never meet")
    if a.is_complex != b.is_complex:
        a, b = a.as_complex(), b.as_complex()
    rest = [[c for c in t.df.columns if c not in common] for t in (a, b)]
    left, right = (_gathered(t, common, HELD, PACK).withColumnsRenamed({c: f"{s}{c}" for c in cols}) for t, cols, s in ((a, rest[0], "__a_"), (b, rest[1], "__b_")))
    on, right = list(common), right.drop("__part")
    if salts > 1:
        left = left.withColumn("__salt", F.pmod(F.xxhash64(*common) + F.col("__part"), F.lit(salts)).cast("int"))
        right = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        on.append("__salt")
    axes = output_axes([x for t in (a, b) for x in t.axes if x.col not in common], [])
    entries = [F.explode(F.arrays_zip(*[f"{s}{c}" for c in cols])).alias(s) for cols, s in zip(rest, ("__a_", "__b_"), strict=True)]
    met = left.drop("__part").join(right, on)
    met = met.select(entries[0], *[f"__b_{c}" for c in rest[1]]).select("__a_", entries[1])
    field = lambda s, c: F.col(s)[f"{s}{c}"]
    cols = [field("__a_" if x in a.axes else "__b_", x.col).alias(x.col) for x in axes]
    return Tensor(axes, met.select(*cols, B.mul(field("__a_", "v"), field("__b_", "v"), a.is_complex).alias("v")))


def accumulate(products: Tensor, path: str, checkpoint: str, partitions: int | None = None, state: dict[str, str] = STATE, **trigger) -> StreamingQuery:
    """Writes each batch's sums as `batch=<n>` below path. A batch that is run again after a failure takes the place of its folder,
    so nothing counts twice. trigger: as of writeStream; what is there, then stop, by default.

    partitions: how many the state has. Each batch commits all of them and the first start of a checkpoint fixes their number, so
    take the cores, or more where a partition's state would outgrow an executor's disk; the session's number by default. state:
    settings of the state, in force for this stream alone. A checkpoint goes on with those that it was started with.
    """
    cols, z, path, spark = [a.col for a in products.axes], products.is_complex, path.rstrip("/"), products.df.sparkSession

    def add(batch, number):
        sums = batch.groupBy(*cols).agg(B.total(F.col("v"), z).alias("v")) if cols else _one_row(batch, products.kind)
        sums.write.mode("overwrite").parquet(f"{path}/batch={number:012d}")

    stream = products.df.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True}))
    with _settings(spark, state | ({"spark.sql.shuffle.partitions": str(partitions)} if partitions else {})):
        return stream.start()


def accumulated(spark: SparkSession, path: str, axes: tuple[Axis, ...]) -> Tensor:
    """The contraction so far: the sum of all finished batches. Without any, an empty tensor; a scalar is zero then."""
    path = path.rstrip("/")
    folders = [f"{path}/batch={n:012d}" for n in committed(spark, path, "batch")]
    rows = spark.read.parquet(*folders) if folders else Tensor.empty(spark, list(axes)).df
    if not axes:
        return Tensor((), _one_row(rows, rows.schema["v"].dataType))
    return Tensor.coo(rows, list(axes))
