"""Near-duplicate vectors by sorted projection passes.

A pass orders the distinct vectors lexicographically by concatenated random hashes: bits that say on which side of a random
plane a vector lies, each plane set at the median of all vectors, which two counts of all of them find. Only these compact keys are sorted. The order is cut
into windows of bounded size, at another place in each pass, and all pairs of a window are verified by cosine; what links is
united across passes. Passes go on until a round finds next to nothing, measured against what was found after the first round:
copies that any pass finds are united in the first round, so that they can't end the search for pairs that are hard to find. The
number of passes grows with the rows and with the density of what lies close together.

Links are then counted inside the components found. In a large component all vectors within half the angle of its mean link
with each other (triangle inequality of angles), so only the others are compared, in blocks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tensorloom.llm.common import cut, drop, ranked
from tensorloom.llm.components import components

WINDOW, NUMBERS = 2048, 1 << 22  # vectors, and about how many numbers, of a window
BINS = 256  # of a count of projections; the second one cuts the first one's bin again
RECALL = 0.99
BITS, STRIP, PAIRS = 63, 256, 1 << 16


def passes_needed(n: int, cosine: float, window: int = WINDOW, recall: float = RECALL) -> int:
    """Passes that bring a pair at the threshold into one window with this chance, among n vectors without any structure.

    n / window vectors share the first log2 of it bits; the pair shares a bit with the chance 1 - angle / pi.
    """
    if n <= window:
        return 1
    share = (1 - math.acos(cosine) / math.pi) ** (math.log2(n / window) + 1)
    return max(2, math.ceil(math.log(1 - recall) / math.log(1 - share)))


def _matrix(column: pa.Array, dim: int, kind: str) -> np.ndarray:
    """Unit vectors in double precision of packed vectors of one length."""
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(column.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    x = raw.view(kind).astype(np.float64).reshape(len(column), dim)
    x = x / np.abs(x).max(axis=1, initial=1e-300)[:, None]
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _packed(kind: str):
    """Batches of (vec_id, v as array) -> (vec_id, h1, h2, dim, v): 128 bits of hash, the length and the packed numbers. Vectors
    that can't link have null there."""

    def run(batches):
        for batch in batches:
            column, ids = batch.column("v"), batch.column("vec_id")
            sizes = np.array(column.value_lengths().fill_null(0))
            flat = column.flatten()
            x = flat.to_numpy(zero_copy_only=False).astype(kind) + np.zeros(1, kind)  # -0.0 is 0.0; nulls are nan
            ends = np.cumsum(sizes)
            wrong = np.concatenate([[0], np.cumsum(~np.isfinite(x) | np.array(flat.is_null()))])
            some = np.concatenate([[0], np.cumsum(x != 0)])
            good = (wrong[ends] == wrong[ends - sizes]) & (some[ends] > some[ends - sizes]) & np.array(ids.is_valid())
            rows, marks = [None] * len(sizes), np.zeros((2, len(sizes)), np.int64)
            for i in np.flatnonzero(good).tolist():
                rows[i] = x[ends[i] - sizes[i] : ends[i]].tobytes()
                h = xxhash.xxh3_128_intdigest(rows[i])
                marks[:, i] = (h & (2**64 - 1)) - 2**63, (h >> 64) - 2**63
            yield pa.RecordBatch.from_arrays([ids, pa.array(marks[0], mask=~good), pa.array(marks[1], mask=~good), pa.array(sizes.astype(np.int32)), pa.array(rows, pa.binary())], ["vec_id", "h1", "h2", "dim", "v"])

    return run


def _runs(key_cols: list[str], work):
    """Batches sorted by key_cols -> work(key, rows as a table) for each run of equal keys; a run is held at a time."""

    def run(batches):
        held, now = [], None
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in key_cols), strict=True))
            start = 0
            for i in range(1, len(keys) + 1):
                if i == len(keys) or keys[i] != keys[start]:
                    if held and now != keys[start]:
                        yield from work(now, pa.Table.from_batches(held).combine_chunks())
                        held = []
                    now = keys[start]
                    held.append(batch.slice(start, i - start))
                    start = i
        if held:
            yield from work(now, pa.Table.from_batches(held).combine_chunks())

    return run


def _unite(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the trees of a[i] and b[i]; root has the root of each place, before and after."""
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (up := root[root]).tobytes() != root.tobytes():
            root[:] = up


def _near(x: np.ndarray, y: np.ndarray, rough: np.ndarray, cosine: float, wanted=None):
    """Places (i, j) with cosine of x[i] and y[j] at the threshold, PAIRS at a time; rough: their products in single precision.
    wanted(i, j): which pairs still matter."""
    i, j = np.divmod(np.flatnonzero(rough >= cosine - 1e-4), max(1, len(y)))  # faster than nonzero in two dimensions
    for at in range(0, len(i), PAIRS):
        a, b = i[at : at + PAIRS], j[at : at + PAIRS]
        if wanted is not None:
            ok = wanted(a, b)
            a, b = a[ok], b[ok]
        # far above the threshold single precision decides
        ok = rough[a, b] >= cosine + 1e-4
        unsure = np.flatnonzero(~ok)
        ok[unsure] = np.einsum("ij,ij->i", x[a[unsure]], y[b[unsure]]) >= cosine
        yield a[ok], b[ok]


def _projected(batch: pa.RecordBatch, passes: range, seed: int, kind: str, planes: dict):
    """(dim, pass, rows of the batch, their projections on the pass's planes); planes keeps what was drawn."""
    dims = batch.column("dim").to_numpy()
    for dim in np.unique(dims).tolist():
        at = pa.array(np.flatnonzero(dims == dim))
        x = _matrix(batch.column("v").take(at), dim, kind).astype(np.float32)
        for p in passes:
            if (dim, p) not in planes:
                r = np.random.default_rng([seed, dim, p]).standard_normal((dim, BITS)).astype(np.float32)
                planes[dim, p] = r / np.sqrt((r * r).sum(axis=0))  # projections lie from -1 to 1
            yield dim, p, at, x @ planes[dim, p]


HELD = 64  # counts that a task holds


def _counts(ranges: dict, passes: range, seed: int, kind: str):
    """Batches of (dim, v) -> (dim, pass, counts): of each plane, how many vectors project below its range (low, width), into
    each bin of it, and above. Only lengths in ranges; others have no row."""

    def flushed(held: dict):
        for (dim, p), counts in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([p], pa.int32()), pa.array([counts.tobytes()], pa.binary())], ["dim", "pass", "counts"])

    def run(batches):
        planes, held, edge = {}, {}, np.arange(BITS) * (BINS + 2)
        for batch in batches:
            batch = batch.filter(pa.array(np.isin(batch.column("dim").to_numpy(), list({dim for dim, _ in ranges}))))
            for dim, p, _, y in _projected(batch, passes, seed, kind, planes):
                low, width = ranges[dim, p]
                place = np.clip(np.floor((y - low) * (BINS / width)) + 1, 0, BINS + 1).astype(np.int64) + edge
                if (dim, p) not in held and len(held) >= HELD:
                    yield from flushed(held)
                    held = {}
                held[dim, p] = held.get((dim, p), 0) + np.bincount(place.ravel(), minlength=BITS * (BINS + 2))
            if len(planes) > HELD:
                planes.clear()
        yield from flushed(held)

    return run


def _added(batches):
    """Counts sorted by (dim, pass) -> their sums."""
    held, now = None, None
    row = lambda: pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.int32()), pa.array([held.tobytes()], pa.binary())], ["dim", "pass", "counts"])
    for batch in batches:
        for *key, counts in zip(*(batch.column(c).to_pylist() for c in ("dim", "pass", "counts")), strict=True):
            counts = np.frombuffer(counts, np.int64)
            if now is not None and now != key:
                yield row()
                held = None
            held, now = counts if held is None else held + counts, key
    if now is not None:
        yield row()


def _bins(batches):
    """Summed counts -> (dim, pass, bins): the bin of each plane that holds its median."""
    for batch in _added(batches):
        counts = np.frombuffer(batch.column("counts")[0].as_py(), np.int64).reshape(BITS, -1)
        half = (counts.sum(axis=1) + 1) // 2
        bins = (counts.cumsum(axis=1) >= half[:, None]).argmax(axis=1) - 1
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([np.clip(bins, 0, BINS - 1).tolist()], pa.list_(pa.int32()))], ["dim", "pass", "bins"])


def _middles(entries: DataFrame, dims: list[int], passes: range, seed: int, kind: str) -> dict:
    """(dim, pass) -> the medians of all vectors' projections on the pass's planes, to 2 / BINS ** 2. Every vector of the lengths
    in dims is counted, twice; of each length and pass the driver has one number a plane."""
    ranges = {(dim, p): (np.full(BITS, -1.0), np.full(BITS, 2.0)) for dim in dims for p in passes}
    for _ in range(2 if dims else 0):
        schema, keys = "dim int, pass int, counts binary", ["dim", "pass"]
        counts = entries.select("dim", "v").mapInArrow(_counts(ranges, passes, seed, kind), schema)
        found = counts.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_bins, "dim int, pass int, bins array<int>").collect()
        for row in found:
            low, width = ranges[row.dim, row["pass"]]
            ranges[row.dim, row["pass"]] = low + np.array(row.bins) * (width / BINS), width / BINS
    return {key: low + width / 2 for key, (low, width) in ranges.items()}


def _keys(middles: dict, passes: range, seed: int, kind: str):
    """Batches of (node, h1, dim, v) -> (pass, dim, key, node, h1)."""

    def run(batches):
        planes: dict = {}
        for batch in batches:
            for dim, p, at, y in _projected(batch, passes, seed, kind, planes):
                key = (y > middles.get((dim, p), 0.0)).astype(np.int64) @ (np.int64(1) << np.arange(BITS - 1, -1, -1, dtype=np.int64))
                cols = [pa.array(np.full(len(at), p, np.int32)), pa.array(np.full(len(at), dim, np.int32)), pa.array(key), batch.column("node").take(at), batch.column("h1").take(at)]
                yield pa.RecordBatch.from_arrays(cols, ["pass", "dim", "key", "node", "h1"])
            if len(planes) > HELD:
                planes.clear()

    return run


def _merges(cosine: float, kind: str):
    """Rows of a window -> links between components that were apart, one for each that ends."""

    def work(key, table):
        comp = table.column("comp").to_numpy()
        x = _matrix(table.column("v").combine_chunks(), key[-1], kind)
        small, names, first, inverse = x.astype(np.float32), *np.unique(comp, return_index=True, return_inverse=True)
        root = first[inverse]
        for at in range(0, len(x), STRIP):
            strip = slice(at, at + STRIP)
            for i, j in _near(x[strip], x[at:], small[strip] @ small[at:].T, cosine, lambda a, b: root[at + a] != root[at + b]):  # noqa: B023
                _unite(root, at + i, at + j)
        ended = np.flatnonzero(root[first] != first)
        if len(ended):
            yield pa.RecordBatch.from_arrays([pa.array(names[ended]), pa.array(comp[root[first[ended]]])], ["a", "b"])

    return work


def _passes(entries: DataFrame, n: int, cosine: float, window: int, recall: float, seed: int, kind: str) -> DataFrame:
    """(node, comp) of the entries that link; see the module."""
    spark = entries.sparkSession
    # fewer vectors of a length lie in a window or two, whatever the planes
    dims = [r.dim for r in entries.groupBy("dim").count().where(F.col("count") >= window).select("dim").collect()]  # at most n / window
    known = spark.createDataFrame([], "node long, comp long")
    base = passes_needed(n, cosine, window, recall)
    size, done, later = -(-base // 3), 0, 0
    while True:
        passes = range(done, done + size)
        middles = _middles(entries, dims if n > window else [], passes, seed, kind)
        keys = entries.select("node", "h1", "dim", "v").mapInArrow(_keys(middles, passes, seed, kind), "pass int, dim int, key long, node long, h1 long")
        # a pass has n rows, so the number within it is the remainder
        placed = ranked(keys, ["pass", "dim", "key", "node", "h1"], "rank")
        shift = F.pmod(F.xxhash64("pass"), F.lit(window)) if n > window else F.lit(0)
        placed = placed.select("pass", "dim", "node", "h1", ((F.col("rank") % n + shift) / window).cast("long").alias("window"))
        named = entries.select("node", "h1", "v").join(known, "node", "left").select("node", "h1", "v", F.coalesce("comp", "node").alias("comp"))
        where = ["pass", "window", "dim"]
        rows = placed.join(named, ["node", "h1"]).select(*where, "comp", "v")
        windows = size * -(-n // window)
        tasks = min(10_000, max(min(12, windows), windows // 8))
        links = cut(rows.repartition(tasks, *where).sortWithinPartitions(*where).mapInArrow(_runs(where, _merges(cosine, kind)), "a long, b long"), "links")
        done += size
        new = cut(components(links).withColumnRenamed("component", "comp"), "merged")
        merged = new.where("node <> comp").count()
        if merged:
            moved = known.join(new.select(F.col("node").alias("comp"), F.col("comp").alias("to")), "comp", "left").select("node", F.coalesce("to", "comp").alias("comp"))
            before, known = known, cut(moved.union(new.join(known, "node", "left_anti").select("node", "comp")), "known")
            drop(before)
        later += merged if done > size else 0
        if n <= window or done >= base and done > size and merged <= (1 - recall) * later:
            return known


def _inside(cosine: float, kind: str):
    """Rows of one component -> links of each row."""

    def work(key, table):
        x, copies = _matrix(table.column("v").combine_chunks(), key[-1], kind), table.column("copies").to_numpy()
        small, sums = x.astype(np.float32), np.zeros(len(x), np.int64)
        for at in range(0, len(x), STRIP):
            strip = slice(at, at + STRIP)
            for i, j in _near(x[strip], x, small[strip] @ small.T, cosine, lambda a, b: at + a != b):  # noqa: B023
                np.add.at(sums, at + i, copies[j])
        yield pa.RecordBatch.from_arrays([table.column("node").combine_chunks(), table.column("h1").combine_chunks(), pa.array(sums)], ["node", "h1", "links"])

    return work


def _across(cosine: float, kind: str):
    """A block of a component's outer vectors (side 0) and a block of all its vectors (side 1) -> links of the outer ones with
    these, and of the inner ones with the outer ones."""

    def work(key, table):
        side, outer, copies = (table.column(c).to_numpy(zero_copy_only=False) for c in ("side", "outer", "copies"))
        node, h1 = table.column("node").to_numpy(), table.column("h1").to_numpy()
        x = _matrix(table.column("v").combine_chunks(), key[1], kind)
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        small, sums = x.astype(np.float32), np.zeros(len(x), np.int64)
        for at in range(0, len(a), STRIP):
            f = a[at : at + STRIP]
            for i, j in _near(x[f], x[b], small[f] @ small[b].T, cosine):
                i, j = f[i], b[j]
                other = (node[i] != node[j]) | (h1[i] != h1[j])
                i, j = i[other], j[other]
                np.add.at(sums, i, copies[j])
                inner = ~outer[j]
                np.add.at(sums, j[inner], copies[i[inner]])
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(h1[some]), pa.array(sums[some])], ["node", "h1", "links"])

    return work


def _sums(kind: str | None):
    """Rows by component -> (comp, dim, sum): sums of unit vectors, or of sums. What a batch holds is added at once."""

    def work(key, table):
        column = table.column("v").combine_chunks()
        x = _matrix(column, key[1], kind) if kind else np.stack([np.frombuffer(v, np.float64) for v in column.to_pylist()])
        yield pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int32()), pa.array([x.sum(axis=0).tobytes()], pa.binary())], ["comp", "dim", "v"])

    def each(batches):
        for batch in batches:
            yield from _runs(["comp", "dim"], work)([batch.sort_by([("comp", "ascending")])])

    return each if kind else _runs(["comp", "dim"], work)


def _outer(cosine: float, kind: str):
    """Batches with the component's sum c -> with `outer`: whether a vector lies beyond half the angle from it."""
    half = math.cos(math.acos(cosine) / 2 - 1e-6)

    def run(batches):
        for batch in batches:
            outer, dims = np.ones(batch.num_rows, bool), batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                x, c = (_matrix(batch.column(name).take(pa.array(at)), dim, k) for name, k in (("v", kind), ("c", "<f8")))
                outer[at] = ~(np.einsum("ij,ij->i", x, c) >= half)
            yield batch.drop_columns("c").append_column("outer", pa.array(outer))

    return run


def _counted(entries: DataFrame, comps: DataFrame, cosine: float, window: int, kind: str) -> DataFrame:
    """(node, h1, links): how many other rows each linked entry links with, over its component."""
    schema = "node long, h1 long, links long"
    members = cut(entries.join(comps, "node").select("comp", "dim", "node", "h1", "copies", "v"), "members")
    sizes = cut(members.groupBy("comp").agg(F.count(F.lit(1)).alias("n")), "sizes")
    wide, tasks = max(16, window // 16), min(10_000, max(1, 4 * -(-members.count() // window)))
    few, keys = members.join(sizes.where(F.col("n") <= wide), "comp").select(*members.columns), ["comp", "dim"]
    out = few.repartition(tasks, *keys).sortWithinPartitions(*keys).mapInArrow(_runs(keys, _inside(cosine, kind)), schema)
    sizes = sizes.where(F.col("n") > wide)
    if sizes.isEmpty():
        return out
    large = cut(members.join(sizes, "comp"), "large")
    summed = "comp long, dim int, v binary"
    centre = large.select("comp", "dim", "v").mapInArrow(_sums(kind), summed).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_sums(None), summed)
    told = large.join(centre.withColumnRenamed("v", "c"), keys).select(*large.columns, "c")
    large = cut(told.mapInArrow(_outer(cosine, kind), "comp long, dim int, node long, h1 long, copies long, v binary, n long, outer boolean"), "large")
    held = large.groupBy("comp").agg(F.sum(F.when(~F.col("outer"), F.col("copies"))).alias("inner"), F.count(F.when(F.col("outer"), 1)).alias("n_outer"))
    large = large.join(held, "comp")
    within = large.where("not outer").select("node", "h1", (F.col("inner") - F.col("copies")).alias("links"))
    # of the outer vectors each block meets each block of all
    blocks = lambda n: F.ceil(F.col(n) / window).cast("int")
    own = lambda n: F.array(F.pmod(F.xxhash64("h1"), blocks(n)).cast("int"))
    every = lambda n: F.sequence(F.lit(0), blocks(n) - 1)
    mixed = large.where("n_outer > 0")
    first = mixed.where("outer").withColumn("s", F.explode(own("n_outer"))).withColumn("t", F.explode(every("n"))).withColumn("side", F.lit(0))
    second = mixed.withColumn("s", F.explode(every("n_outer"))).withColumn("t", F.explode(own("n"))).withColumn("side", F.lit(1))
    keys = ["comp", "dim", "s", "t"]
    met = first.unionByName(second).select(*keys, "side", "outer", "node", "h1", "copies", "v")
    across = met.repartition(max(tasks, 32), *keys).sortWithinPartitions(*keys).mapInArrow(_runs(keys, _across(cosine, kind)), schema)
    return out.union(within).union(across).groupBy("node", "h1").agg(F.sum("links").alias("links"))


def near_vectors(vectors: DataFrame, cosine: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", window: int | None = None, recall: float = RECALL, seed: int = 2026) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vectors.

    Cosines are taken in double precision; no link below the threshold is made. Null, empty and zero vectors and such with
    null or non-finite components link with nothing, nor do vectors of different lengths. n_links: other rows linked directly,
    counted over the whole component; component_id: the smallest id reachable; kept: the row has that id. Equal vectors are
    one entry with a count, and always linked. Rows that repeat an id with different vectors count as one vertex. A null id
    stays unlinked with component_id null and kept false. Other columns are ignored; no rows give none. A
    window has 2048 distinct vectors (fewer of over 2048 numbers), and never more than an eighth of them from 512 on; links are
    found with about `recall`.
    """
    single = vectors.schema[vector_col].dataType.simpleString() == "array<float>"
    kind = "<f4" if single else "<f8"
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<float>" if single else "array<double>").alias("v"))
    rows = v.mapInArrow(_packed(kind), "vec_id long, h1 long, h2 long, dim int, v binary")
    some = [F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("copies"), F.first("dim").alias("dim"), F.first("v").alias("v")]
    entries = cut(rows.where("v is not null").groupBy("h1", "h2").agg(*some), "entries")
    n, dim = entries.agg(F.count(F.lit(1)), F.coalesce(F.max("dim"), F.lit(1))).first()
    window = window or max(64, min(WINDOW, max(256, NUMBERS // dim), n // 8))  # well below the table at every size
    told = entries.select("h1", "h2", "node", "copies")
    if n:
        comps = cut(_passes(entries, n, cosine, window, recall, seed, kind), "comps")
        counted = cut(_counted(entries, comps, cosine, window, kind), "counted")
        told = told.join(comps, "node", "left").join(counted, ["node", "h1"], "left")
    else:
        told = told.withColumns({"comp": F.lit(None).cast("long"), "links": F.lit(None).cast("long")})
    told = told.select("h1", "h2", "copies", F.coalesce("comp", "node").alias("component"), F.coalesce("links", F.lit(0)).alias("links"))
    linked = rows.where("h1 is not null").select("vec_id", "h1", "h2").join(told, ["h1", "h2"]).select("vec_id", (F.col("links") + F.col("copies") - 1).alias("n_links"), F.col("component").alias("component_id"))
    alone = rows.where("h1 is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
