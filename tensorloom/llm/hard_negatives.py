"""Hard negatives by dual-tree search.

Each anchor's positives are its best-scoring rows of the same label; the hard negatives of an anchor and a positive are the
best-scoring rows of other labels within a band below the positive's score. Scores are exact whole inner products.

Rows are ordered by label and by the sides of random planes, and cut into blocks of bounded size. All anchors, the stated
queries, go to each block, a group of them at a time; a task builds a ball tree over its block and one over the group, and walks
pairs of nodes. The inner products of two balls lie in an interval around that of their centres. A pair of nodes whose interval
misses what every anchor of the node still wants is dropped with all anchors and rows below it; leaf pairs are scored exactly.
Each task gives at most k rows an anchor (and positive), from which the best are taken over all blocks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tensorloom.llm.common import cut, ranked

BLOCK = 32_768  # rows of a block
GROUP = 1024  # anchors of a group
LEAF, ANCHOR_LEAF = 256, 32
PLANES = 62
EXACT = 2.0**53


@dataclass
class Tree:
    """A ball tree: rows of a node are order[start:end]; children of node i are left[i] and left[i] + 1, or -1."""

    order: np.ndarray
    start: np.ndarray
    end: np.ndarray
    left: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    size: np.ndarray  # of the centre


def ball_tree(x: np.ndarray, leaf: int) -> Tree:
    """Nodes are halved at the median along the direction of the two rows that lie far apart, down to `leaf` rows."""
    order = np.arange(len(x))
    starts, ends, left = [0], [len(x)], [-1]
    i = 0
    while i < len(starts):
        s, e = starts[i], ends[i]
        if e - s > leaf:
            rows = x[order[s:e]]
            far = rows[((rows - rows[0]) ** 2).sum(axis=1).argmax()]
            away = rows[((rows - far) ** 2).sum(axis=1).argmax()]
            half = (e - s) // 2
            order[s:e] = order[s:e][np.argpartition(rows @ (far - away), half)]
            left[i] = len(starts)
            starts += [s, s + half]
            ends += [s + half, e]
            left += [-1, -1]
        i += 1
    centre = np.stack([x[order[s:e]].mean(axis=0) for s, e in zip(starts, ends, strict=True)])
    # a little wider than computed, so that rounding never drops a pair
    radius = np.array([np.sqrt(((x[order[s:e]] - c) ** 2).sum(axis=1).max()) for s, e, c in zip(starts, ends, centre, strict=True)]) * (1 + 1e-9) + 1e-9
    return Tree(order, np.array(starts), np.array(ends), np.array(left), centre, radius, np.linalg.norm(centre, axis=1))


def interval(a: Tree, i: np.ndarray, b: Tree, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the inner products between nodes i of a and nodes j of b."""
    middle = np.einsum("ij,ij->i", a.centre[i], b.centre[j])
    wide = a.size[i] * b.radius[j] + b.size[j] * a.radius[i] + a.radius[i] * b.radius[j]
    wide = wide + 1e-12 * (np.abs(middle) + a.size[i] * b.size[j])
    return middle - wide, middle + wide


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of whole numbers: in doubles while nothing is rounded, else in Python's whole numbers."""
    top = lambda m: np.abs(m).max(initial=0.0)
    if top(a) * top(b) * a.shape[1] < EXACT:
        return a @ b.T
    whole = lambda m: np.array([[int(v) for v in row] for row in m], object).reshape(m.shape)
    return whole(a) @ whole(b).T


class Search:
    """Of each anchor and slot the best k rows of a block; a slot is what one anchor looks for (a band of scores, or all)."""

    def __init__(self, k: int, same: bool):
        self.k, self.same = k, same

    def run(self, anchors: dict, rows: dict, rows_tree: Tree):
        """(place of the anchor, slot, place of the row, score) of at most k rows each.

        anchors: x, label, row, low and high (bands, one column for each slot); rows: x, label, id, row."""
        a, b = ball_tree(anchors["x"], ANCHOR_LEAF), rows_tree
        low, high = anchors["low"], anchors["high"]
        n, slots = low.shape
        best: list = [[[] for _ in range(slots)] for _ in range(n)]
        floor = low.copy()  # what a row must reach to matter for an anchor's slot
        labels = {"a": self._labels(a, anchors["label"]), "b": self._labels(b, rows["label"])}
        i, j = np.zeros(1, np.int64), np.zeros(1, np.int64)
        leaves: list = []
        floor_of, high_of = self._over(a, floor, np.minimum), self._over(a, high, np.maximum)
        while len(i):
            i, j, _ = self._wanted(a, i, b, j, labels, floor_of, high_of)
            down_a, down_b = a.left[i] >= 0, b.left[j] >= 0
            # the wider node of a pair is opened
            open_a = down_a & (~down_b | (a.radius[i] * b.size[j] >= b.radius[j] * a.size[i]))
            open_b = down_b & ~open_a
            done = ~(down_a | down_b)
            leaves.append(np.stack([i[done], j[done]]))
            x, y = a.left[i[open_a]], b.left[j[open_b]]
            i, j = np.concatenate([x, x + 1, i[open_b], i[open_b]]), np.concatenate([j[open_a], j[open_a], y, y + 1])
        i, j = np.concatenate(leaves, axis=1)
        # pairs that can give the most come first, so that the floors rise early; then those below them are dropped
        for node in np.unique(i):
            others = j[i == node]
            _, upper = interval(a, np.full(len(others), node), b, others)
            own = a.order[a.start[node] : a.end[node]]
            for other, top in sorted(zip(others.tolist(), upper.tolist(), strict=True), key=lambda p: -p[1]):
                if top < floor[own].min():
                    break
                self._score(anchors, own, rows, b.order[b.start[other] : b.end[other]], best, floor)
        return [(i, s, r, v) for i in range(n) for s in range(slots) for v, _, _, r in best[i][s]]

    def _labels(self, tree: Tree, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        spans = [label[tree.order[s:e]] for s, e in zip(tree.start, tree.end, strict=True)]
        return np.array([x.min() for x in spans]), np.array([x.max() for x in spans])

    @staticmethod
    def _over(tree: Tree, values: np.ndarray, f) -> np.ndarray:
        row = f.reduce(values, axis=1)
        return np.array([f.reduce(row[tree.order[s:e]]) for s, e in zip(tree.start, tree.end, strict=True)])

    def _wanted(self, a: Tree, i, b: Tree, j, labels, floor_of, high_of):
        """The pairs of nodes that can hold a wanted pair of rows."""
        (al, ah), (bl, bh) = labels["a"], labels["b"]
        if self.same:
            ok = (al[i] <= bh[j]) & (bl[j] <= ah[i])
        else:
            ok = ~((al[i] == ah[i]) & (bl[j] == bh[j]) & (al[i] == bl[j]))
        i, j = i[ok], j[ok]
        lower, upper = interval(a, i, b, j)
        ok = (upper >= floor_of[i]) & (lower <= high_of[i])
        return i[ok], j[ok], upper[ok]

    def _score(self, anchors, own, rows, others, best, floor) -> None:
        found = scores(anchors["x"][own], rows["x"][others])
        fits = anchors["label"][own][:, None] == rows["label"][others][None]
        fits = fits & (anchors["row"][own][:, None] != rows["row"][others][None]) if self.same else ~fits
        for s in range(floor.shape[1]):
            ok = fits & (found >= floor[own, s][:, None]) & (found <= anchors["high"][own, s][:, None])
            for p in np.flatnonzero(ok.any(axis=1)).tolist():
                at = np.flatnonzero(ok[p])
                who = int(own[p])
                value = found[p, at]
                if len(at) > self.k:  # ties at the k-th place stay
                    bar = -np.partition(-value.astype(float), self.k - 1)[self.k - 1]
                    at, value = at[value >= bar], value[value >= bar]
                new = best[who][s] + [(v, -int(rows["id"][r]), -int(rows["row"][r]), r) for v, r in zip(value.tolist(), others[at].tolist(), strict=True)]
                best[who][s] = sorted(new, reverse=True)[: self.k]
                if len(best[who][s]) == self.k:
                    floor[who, s] = max(floor[who, s], float(best[who][s][-1][0]))


def _packed(scale: float):
    """Batches of (vec_id, label, v, anchor) -> vec_id, label, anchor, dim, key, v: floor(scale * x) packed as doubles or, where they
    fit, 16-bit numbers; rows that take no part are left out."""

    def run(batches):
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            column, ids, label, anchor = (batch.column(c) for c in ("v", "vec_id", "label", "anchor"))
            sizes = np.array(column.value_lengths().fill_null(0))
            flat = column.flatten()
            raw = flat.to_numpy(zero_copy_only=False).astype(np.float64)
            with np.errstate(over="ignore", invalid="ignore"):
                x = np.floor(scale * raw)
            ends = np.cumsum(sizes)
            wrong = np.concatenate([[0], np.cumsum(~np.isfinite(x) | np.array(flat.is_null()))])
            good = (wrong[ends] == wrong[ends - sizes]) & (sizes > 0) & np.array(ids.is_valid()) & np.array(label.is_valid())
            for dim in np.unique(sizes[good]).tolist():
                at = np.flatnonzero(good & (sizes == dim))
                m = x[(ends - sizes)[at][:, None] + np.arange(dim)]
                if dim not in planes:
                    planes[dim] = np.random.default_rng([7, dim]).standard_normal((dim, PLANES))
                top = np.abs(m).max(axis=1, initial=1e-300)[:, None]
                key = ((m / top) @ planes[dim] > 0).astype(np.int64) @ (np.int64(1) << np.arange(PLANES - 1, -1, -1, dtype=np.int64))
                small = np.abs(m).max(axis=1, initial=0) <= 32767
                v = [r.astype(np.int16).tobytes() if s else r.tobytes() for r, s in zip(m, small, strict=True)]
                take = pa.array(at)
                yield pa.RecordBatch.from_arrays([ids.take(take), label.take(take), anchor.take(take), pa.array(np.full(len(at), dim, np.int32)), pa.array(key), pa.array(v, pa.binary())], ["vec_id", "label", "anchor", "dim", "key", "v"])

    return run


def _numbers(packed: list[bytes], dim: int) -> np.ndarray:
    return np.stack([np.frombuffer(v, np.int16 if len(v) == 2 * dim else np.float64).astype(np.float64) for v in packed])


def _searching(k: int, same: bool, slots: int):
    """Rows sorted by (dim, block, side, row): side 0 are the block's rows, side 1 anchors with their bands. Holds a block and a
    group of anchors."""

    def run(batches):
        search = Search(k, same)
        key, block, parts, tree, group = None, None, [], None, []

        def flush():
            nonlocal block, tree
            if group and (parts or block):
                if block is None:
                    cols = {c: np.concatenate([p[c] for p in parts]) for c in ("x", "label", "id", "row")}
                    block, tree = cols, ball_tree(cols["x"], LEAF)
                    parts.clear()
                anchors = {c: np.concatenate([g[c] for g in group]) for c in ("x", "label", "row", "low", "high")}
                found = search.run(anchors, block, tree)
                if found:
                    i, s, r, v = zip(*found, strict=True)
                    i, r = np.array(i), np.array(r)
                    cols = [anchors["row"][i], np.array(s, np.int32), block["id"][r], block["row"][r], np.array([int(x) for x in v], np.int64)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["anchor_row", "slot", "vec_id", "row", "score"])
            group.clear()

        for batch in batches:
            dims, blocks, sides = (batch.column(c).to_numpy() for c in ("dim", "block", "side"))
            edges = np.flatnonzero((np.diff(dims) != 0) | (np.diff(blocks) != 0) | (np.diff(sides) != 0)) + 1
            for start, end in zip([0, *edges.tolist()], [*edges.tolist(), len(dims)], strict=True):
                if start == end:
                    continue
                if (dims[start], blocks[start]) != key:
                    yield from flush()
                    key, block, tree = (dims[start], blocks[start]), None, None
                    parts.clear()
                some = batch.slice(start, end - start)
                cols = {"x": _numbers(some.column("v").to_pylist(), int(dims[start])), **{c: some.column(n).to_numpy() for c, n in (("label", "label"), ("id", "vec_id"), ("row", "row"))}}
                if sides[start] == 0:
                    parts.append(cols)
                    continue
                for name, none in (("low", np.inf), ("high", -np.inf)):  # slots that an anchor lacks want nothing
                    bands = some.column(name)
                    cols[name] = np.full((len(bands), slots), none)
                    cols[name][np.arange(slots) < bands.value_lengths().to_numpy()[:, None]] = bands.flatten().to_numpy()
                for at in range(0, len(cols["row"]), GROUP):
                    group.append({c: m[at : at + GROUP] for c, m in cols.items()})
                    if sum(len(g["row"]) for g in group) >= GROUP:
                        yield from flush()
        yield from flush()

    return run


def _search(rows: DataFrame, anchors: DataFrame, n: int, block: int, k: int, same: bool, slots: int) -> DataFrame:
    """(anchor_row, slot, vec_id, row, score): the best k rows of each anchor and slot. anchors have low and high as arrays of up to
    `slots` numbers."""
    cols = ["dim", "block", "side", "row", "vec_id", "label", "v", "low", "high"]
    blocks = max(1, -(-n // block))
    none = F.lit(None).cast("array<double>")
    here = rows.withColumns({"block": F.col("row").cast("long") / block, "side": F.lit(0), "low": none, "high": none}).withColumn("block", F.floor("block").cast("long"))
    there = anchors.withColumns({"block": F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))), "side": F.lit(1)})
    both = here.select(*cols).unionByName(there.select(*cols))
    dealt = both.repartition(blocks, "block").sortWithinPartitions("dim", "block", "side", "row")
    found = dealt.mapInArrow(_searching(k, same, slots), "anchor_row long, slot int, vec_id long, row long, score long")
    order = Window.partitionBy("anchor_row", "slot").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def mine_hard_negatives(
    vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: float = 1.0,
    id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", block: int = BLOCK,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows where `anchor` holds.

    Components become floor(scale * x) and scores are whole inner products (beyond 64 bits an error). An anchor's positives are its
    `positives` best-scoring other rows of its label; for each, the `negatives` best-scoring rows of other labels with low *
    positive_score <= 100 * score <= high * positive_score. Ties go to the smaller id, then to the earlier row. Rows with a
    null id, label, vector or component, with a non-finite component, or without components take no part. Rows that repeat an id
    are rows of their own; vectors of different lengths don't meet. No anchors or no rows: none out.
    """
    slim = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("v"), F.coalesce(anchor, F.lit(False)).alias("anchor"),
    )
    packed = slim.mapInArrow(_packed(scale), "vec_id long, label long, anchor boolean, dim int, key long, v binary")
    rows = ranked(packed, ["dim", "label", "key", "vec_id", "v"], "row")
    n = rows.count()
    chosen = rows.where("anchor")
    every = lambda x: F.array(F.lit(x).cast("double"))
    first = _search(rows, chosen.withColumns({"low": every("-Infinity"), "high": every("Infinity")}), n, block, positives, True, 1)
    first = cut(first.select("anchor_row", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), F.col("place").alias("slot")), "positives")
    # 80 p <= 100 s <= 100 p in whole numbers is ceil(80 p / 100) <= s <= floor(100 p / 100)
    p = F.col("positive_score").cast("decimal(38,0)")
    bands = first.select("anchor_row", "slot", F.ceil(p * low / 100).cast("double").alias("l"), F.floor(p * high / 100).cast("double").alias("h"))
    bands = bands.groupBy("anchor_row").agg(F.sort_array(F.collect_list(F.struct("slot", "l", "h"))).alias("z")).select(F.col("anchor_row").alias("row"), F.transform("z", lambda z: z["l"]).alias("low"), F.transform("z", lambda z: z["h"]).alias("high"))
    second = _search(rows, chosen.join(bands, "row"), n, block, negatives, False, positives)
    found = second.select("anchor_row", (F.col("slot") + 1).alias("slot"), F.col("place").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = chosen.select(F.col("row").alias("anchor_row"), F.col("vec_id").alias("anchor_id"))
    return found.join(first, ["anchor_row", "slot"]).join(named, "anchor_row").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
