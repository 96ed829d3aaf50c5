"""N-gram Jaccard join: sets in one global order, a prefix tree of them, and bounds that prune its subtrees.

A document is the set of its distinct k-word shingles (64-bit hashes). All sets are ordered by one global order, rare
shingles first. The order comes from a fixed-size count sketch over all documents; any total order gives the same links,
a good one makes fewer comparisons. By the prefix bound two sets that link share l shingles among
their first n - ceil(t n) + l ones. With l at a fiftieth of the set, shingles that start just one set and sets that share too
few go before anything is compared:

1. Documents with equal sets become one class. Each class lists its prefix shingles ("buckets").
2. Classes that share enough buckets, directly or over others, form a cluster. A cluster within a block's bound is one prefix tree, so each set is sent
   once. Of a larger cluster, the sets that meet at the smallest set of a bucket form prefix trees, in blocks of bounded
   size that all hold that set. In both cases each set walks the tree of the smaller ones: the overlap of a shared
   path is computed once for all sets below it, a subtree is left when the lengths that remain can't reach the needed
   overlap, or when all it holds is already connected with the set that walks.
3. Links give components. Buckets of large clusters that still hold two components or more are walked again, so that every
   pair of a shared bucket is either compared or already connected. Large buckets go in blocks: only sets outside the bucket's most frequent
   component meet the others. The result is exact.

Memory of a task is bounded by a block; sizes grow with the number of prefix shingles, not with pairs of a group.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tensorloom.llm.common import HOT, cut, doc_shingles, drop, small_batches, with_hot
from tensorloom.llm.components import LINKS, components, find
from tensorloom.llm.tokens import lean

CELL_BITS = 20  # cells of the count sketch: 2 ** 20, whatever the corpus
EDGE = 64  # shingles on one edge of the tree
FEW = 8  # sets of a bucket whose pairs are counted one by one
BLOCK = 300_000  # shingles in one block, about
COARSE = 16  # blocks of a cluster that isn't divided by its buckets


def least_shared(n: int, percent: int) -> int:
    """How many shingles a set of n elements must share among the first ones with any set that links with it."""
    return 1 + need(n, n, percent) // 50


def prefix_size(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + least_shared(n, percent) if n else 0


def need(n: int, m: int, percent: int) -> int:
    """Least intersection of sets of n and m elements with 100 * intersection >= percent * union."""
    return -(-percent * (n + m) // (100 + percent))


def sketch(docs: DataFrame, k: int, cell_bits: int = CELL_BITS) -> np.ndarray:
    """How many documents have a shingle in each cell, over all documents, as one byte on a logarithmic scale."""
    cells, per_row = 1 << cell_bits, 1 << 15

    def count(batches):
        total, held, size = np.zeros(cells, np.int32), [], 0

        def settle():
            np.add(total, np.bincount((np.concatenate(held) >> np.uint64(64 - cell_bits)).astype(np.int64), minlength=cells), out=total, casting="unsafe")
            held.clear()

        for batch in batches:
            for s in doc_shingles(batch.column("text"), k):
                held.append(s)
                size += len(s)
                if size > 500_000:
                    settle()
                    size = 0
        if held:
            settle()
        for i in range(0, cells, per_row):
            if total[i : i + per_row].any():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([zlib.compress(total[i : i + per_row].tobytes(), 1)], pa.binary())], ["at", "counts"])

    def merge(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                more = np.frombuffer(zlib.decompress(counts), np.int32).astype(np.int64)
                sums[at] = sums[at] + more if at in sums else more
        for at, v in sums.items():
            level = np.minimum(255, np.round(8 * np.log2(1 + v))).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([level.tobytes()], pa.binary())], ["at", "counts"])

    schema = "at long, counts binary"
    parts = docs.select("text").mapInArrow(lean(count), schema).repartition("at").mapInArrow(lean(merge), schema)
    level = np.zeros(cells, np.uint8)
    for row in parts.collect():  # 2 ** cell_bits bytes, whatever the corpus
        level[row["at"] : row["at"] + (1 << 15)] = np.frombuffer(row["counts"], np.uint8)
    return level


def _ordered(s: np.ndarray, level: np.ndarray, cell_bits: int) -> np.ndarray:
    """The set in the global order: by level, then by hash."""
    return s[np.argsort(level[(s >> np.uint64(64 - cell_bits)).astype(np.int64)], kind="stable")]


class _Node:
    __slots__ = ("edge", "last", "kids", "ends", "least", "most", "deep", "any", "same")

    def __init__(self, edge):
        self.edge, self.last = edge, edge[-1] if edge else -1
        self.kids: dict[int, _Node] = {}
        self.ends: list[int] = []
        self.least, self.most, self.deep, self.any, self.same = 1 << 60, 0, 0, None, True


class PrefixTree:
    """A trie of ordered sets with at most EDGE elements on an edge, and the components of what it holds."""

    def __init__(self, percent: int, parent: dict):
        self.percent, self.parent, self.root, self.sizes, self.names = percent, parent, _Node([]), [], []

    def insert(self, name, s: list[int]) -> None:
        """Add a set no smaller than those before."""
        me, n = len(self.sizes), len(s)
        self.sizes.append(n)
        self.names.append(name)
        node, i, own = self.root, 0, find(self.parent, name)
        while True:
            node.least, node.most, node.deep = min(node.least, n), max(node.most, n), max(node.deep, n - i)
            if node.any is None:
                node.any = name
            elif node.same:
                node.same = find(self.parent, node.any) == own
            if i == n:
                node.ends.append(me)
                return
            kid = node.kids.get(s[i])
            if kid is None:
                kid = node.kids[s[i]] = _Node(s[i : i + EDGE])
            else:
                edge = kid.edge
                common = next((j for j, e in enumerate(edge) if i + j >= n or s[i + j] != e), len(edge))
                if common < len(edge):  # split the edge
                    upper = _Node(edge[:common])
                    upper.kids[edge[common]] = kid
                    upper.least, upper.most, upper.any, upper.same = kid.least, kid.most, kid.any, kid.same
                    kid.edge, upper.deep = edge[common:], kid.deep + len(edge) - common
                    node.kids[s[i]] = kid = upper
            i += len(kid.edge)
            node = kid

    def links(self, name, s: list[int]):
        """Sets of the tree that link with s, one at least for each component of such sets."""
        n, own, percent, parent = len(s), set(s), self.percent, self.parent
        todo = [(self.root, 0, 0)]
        while todo:
            node, depth, over = todo.pop()
            if node.same and node.any is not None and find(parent, node.any) == find(parent, name):
                continue
            if node.edge:
                over += len(own.intersection(node.edge))
                depth += len(node.edge)
            least = need(n, max(node.least, depth), percent)
            # what is left of the sets below, and of s behind the edge's last element
            if over + min(node.deep, n - bisect_right(s, node.last)) < least or depth - over > node.most - need(n, node.most, percent):
                continue
            for j in node.ends:
                if 100 * over >= percent * (n + self.sizes[j] - over) and find(parent, self.names[j]) != find(parent, name):
                    a, b = sorted((find(parent, self.names[j]), find(parent, name)))
                    parent[b] = a
                    yield self.names[j]
            todo.extend((kid, depth, over) for kid in node.kids.values())


def tree_join(names: list, sets: list[np.ndarray], groups: list, percent: int, order=None) -> list[tuple]:
    """Links between the named sets of one block that connect components; groups: components known before."""
    if len(names) < 2:
        return []
    # ranks in the block's part of the global order are small whole numbers
    flat = np.concatenate(sets)
    distinct, inverse = np.unique(flat, return_inverse=True)
    if order is not None:
        by = np.argsort(order(distinct), kind="stable")
        rank = np.empty(len(by), np.int64)
        rank[by] = np.arange(len(by))
        inverse = rank[inverse]
    parts = np.split(inverse, np.cumsum([len(s) for s in sets])[:-1])
    parent: dict = {}
    first: dict = {}
    for name, group in zip(names, groups, strict=True):
        r, f = find(parent, name), find(parent, first.setdefault(group, name))
        if r != f:
            parent[max(r, f)] = min(r, f)
    tree, out = PrefixTree(percent, parent), []
    for i in sorted(range(len(names)), key=lambda i: (len(sets[i]), names[i])):
        s = np.sort(parts[i]).tolist()
        out += [(names[i], other) for other in tree.links(names[i], s)]
        tree.insert(names[i], s)
    return out


def _blocks(keys: int, percent: int, order):
    """Rows (keys..., node, grp, seq) sorted by the keys -> links; a block is held at a time."""

    def run(batches):
        now, names, sets, groups = None, [], [], []

        def links():
            found = tree_join(names, sets, groups, percent, order)
            return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], ["a", "b"])

        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(keys + 2)]
            seq = batch.column(keys + 2)
            for i, key in enumerate(zip(*cols[:keys], strict=True)):
                if key != now:
                    if len(names) > 1:
                        yield links()
                    now, names, sets, groups = key, [], [], []
                names.append(cols[keys][i])
                groups.append(cols[keys + 1][i])
                sets.append(seq[i].values.to_numpy(zero_copy_only=False).view(np.uint64))
        if len(names) > 1:
            yield links()

    return run


def _lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    flat = np.concatenate(rows) if rows else np.empty(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.view(np.int64), pa.int64()))


def _hot_cells(level: np.ndarray, cell_bits: int) -> list[int]:
    """Cells with more than a HOT-th of what the sketch counts, so fewer than about HOT."""
    n = 2.0 ** (level / 8) - 1
    return np.flatnonzero(n * HOT > n.sum()).tolist()


def _repeated(batches):
    """Rows (token, node, np, hot) sorted by token -> those that are hot or whose token another row has too; one batch and
    one row are held."""
    rest = None
    for batch in batches:
        if rest is not None:
            batch = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
        token = batch.column(0).to_numpy()
        same = token[1:] == token[:-1]
        n = len(token) - 1
        keep = batch.column(3).to_numpy(zero_copy_only=False).copy()
        keep[1:] |= same
        keep[:-1] |= same
        if rest is not None and held:
            keep[0] = True
        # the last row waits for its neighbour
        yield batch.slice(0, n).filter(pa.array(keep[:n]))
        rest, held = batch.slice(n, 1), bool(keep[n])
    if rest is not None and held:
        yield rest


MARK_BITS = 24  # of the bitmap of ids with buckets, whatever the corpus


def _mark(ids: np.ndarray):
    h = ids.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - MARK_BITS)
    return (h >> np.uint64(6)).astype(np.int64), h & np.uint64(63)


def _marks(nodes: DataFrame) -> np.ndarray:
    """A bitmap of hashed ids, 2 ** MARK_BITS bits."""

    def run(batches):
        for batch in batches:
            word, bit = _mark(batch.column(0).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array((np.uint64(1) << bit).view(np.int64))], ["w", "b"])

    out = np.zeros(1 << (MARK_BITS - 6), np.uint64)
    found = nodes.mapInArrow(lean(run), "w long, b long").groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
    out[found.w.to_numpy(np.int64)] = found.b.to_numpy(np.int64).view(np.uint64)
    return out


def _large_clusters(buckets: DataFrame, sets: DataFrame, percent: int, order) -> DataFrame:
    """Links that connect what links within clusters too large for one block."""
    # every set meets the smallest set of each of its buckets, among sets of one size step
    step = F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / percent))).cast("int")
    bucket = buckets.withColumn("step", step)
    head = bucket.groupBy("token", "step").agg(F.min_by("node", F.struct("n", "node")).alias("head"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    meets = bucket.join(head, ["token", "step"]).select("head", "node", "n").distinct()
    blocks = meets.groupBy("head").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("blocks"))
    met = meets.join(blocks, "head").withColumn("block", F.explode(F.when(F.col("node") == F.col("head"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")))))
    met = met.select("head", "block", "node", F.col("node").alias("grp")).join(sets, "node").select("head", "block", "node", "grp", "seq")
    links = cut(met.repartition("head", "block").sortWithinPartitions("head", "block").mapInArrow(lean(_blocks(2, percent, order)), LINKS), "links")

    # what still lies in several components of a bucket
    comps = cut(components(links), "components")
    member = buckets.join(comps, "node", "left").select("token", "node", "n", F.coalesce("component", "node").alias("comp"))
    mixed = member.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.sum("n").alias("w"), F.count(F.lit(1)).alias("c"), F.bit_xor(F.xxhash64("node")).alias("x"), F.sum(F.xxhash64("node").bitwiseAND(F.lit((1 << 40) - 1))).alias("y")).where("lo < hi")
    mixed = mixed.groupBy("x", "y", "c", "w").agg(F.min("token").alias("token")).select("token", "w")  # buckets with the same sets once
    rest = cut(member.join(mixed, "token"), "rest")
    per = rest.groupBy("token", "comp", "w").agg(F.sum("n").alias("cw"))
    top = per.groupBy("token", "w").agg(F.max_by("comp", F.struct("cw", "comp")).alias("top"), F.max("cw").alias("cw"))
    top = top.select("token", "top", F.ceil(F.col("w") / BLOCK).cast("int").alias("ba"), F.ceil((F.col("w") - F.col("cw")) / BLOCK).cast("int").alias("bm"))
    rest = rest.join(top, "token")
    slot = lambda b: F.array(F.pmod(F.xxhash64("node"), F.col(b)).cast("int"))
    every = lambda b: F.sequence(F.lit(0), F.col(b) - 1)
    as_any = rest.withColumn("a", F.explode(slot("ba"))).withColumn("m", F.explode(every("bm")))
    as_rare = rest.where("comp <> top and (ba > 1 or bm > 1)").withColumn("a", F.explode(every("ba"))).withColumn("m", F.explode(slot("bm")))
    again = as_any.union(as_rare).select("token", "a", "m", "node", F.col("comp").alias("grp")).distinct()
    again = again.join(sets, "node").select("token", "a", "m", "node", "grp", "seq")
    more = again.repartition("token", "a", "m").sortWithinPartitions("token", "a", "m").mapInArrow(lean(_blocks(3, percent, order)), LINKS)
    more = cut(more, "more")
    return links.union(more)


def ngram_jaccard_join(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs; see the module.

    Sets link when 100 * intersection >= percent * union. component_id is the smallest id reachable by links, itself
    included. Null, empty and blank texts have n_shingles 0 and link with nothing. Very long texts are read
    in pieces; a text's own set is held whole. Rows that repeat an id count as one
    document where links are followed; each row is returned. A null id keeps its row, with component_id null. Other
    columns are ignored. Hash collisions (64 bits) could change an overlap by one with a chance of about
    shingles ** 2 / 2 ** 65.
    """
    with small_batches(docs.sparkSession):
        return _join(docs, k, percent, id_col, text_col)


def _join(docs: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    level = spark.sparkContext.broadcast(sketch(docs, k))

    def heads(batches):
        for batch in batches:
            rows = ([], [], [], [])
            for s in doc_shingles(batch.column("text"), k):
                n = len(s)
                h = xxhash.xxh3_128_intdigest(s.tobytes())
                rows[0].append(n)
                rows[1].append((h & (2**64 - 1)) - 2**63)
                rows[2].append((h >> 64) - 2**63)
                rows[3].append(_ordered(s, level.value, CELL_BITS)[: prefix_size(n, percent)])
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.int64()), _lists(rows[3])], ["doc", "n", "s1", "s2", "prefix"])

    heads_df = cut(docs.mapInArrow(lean(heads), "doc long, n long, s1 long, s2 long, prefix array<long>"), "heads")
    named, alike = F.col("doc").isNotNull() & (F.col("n") > 0), ["s1", "s2"]
    slim = heads_df.select("doc", "n", *alike)
    classes = cut(slim.where(named).groupBy(*alike).agg(F.min("doc").alias("node"), F.count(F.lit(1)).alias("copies")), "classes")
    own = with_hot(slim.where(named), classes, alike, "copies", heads_df.count()).drop("copies")
    own = cut(own.unionByName(slim.where(~named).withColumn("node", F.lit(None).cast("long"))), "own")
    first = own.where("doc = node").select("s1", "s2", F.col("node").alias("doc"), "node").distinct()
    one = heads_df.where("n > 0").join(first, ["doc", "s1", "s2"]).dropDuplicates(["doc", "s1", "s2"])
    # prefix shingles that start two sets at least
    starts = one.select(F.posexplode("prefix").alias("pos", "token"), "node", "n").select("token", "node", F.shiftleft("n", 32).bitwiseOR(F.col("pos").cast("long")).alias("np"))
    # tokens of the sketch's hot cells are spread over tasks, and go on unseen
    cells = _hot_cells(level.value, CELL_BITS)
    hot = F.shiftrightunsigned("token", 64 - CELL_BITS).isin(cells) if cells else F.lit(False)
    starts = starts.withColumn("hot", hot).withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("node"), F.lit(HOT))))
    twice = starts.repartition("token", "salt").drop("salt").sortWithinPartitions("token").mapInArrow(lean(_repeated), "token long, node long, np long, hot boolean")
    shared = cut(twice.select("token", "node", F.shiftright("np", 32).alias("n"), F.col("np").bitwiseAND(F.lit((1 << 32) - 1)).alias("pos")), "shared")
    drop(heads_df)
    # sets that link share `floor` of these buckets. Shared small buckets are counted pair by pair (at most FEW sets each);
    # what a pair shares of larger ones is no more than either set has of them
    counts = cut(shared.groupBy("token").agg(F.count(F.lit(1)).alias("k")), "counts")
    sized = with_hot(shared.select("token", "node", "n"), counts, "token", "k", shared.count())
    floor = lambda n: F.floor(1 + F.ceil(F.ceil(n * percent / 100) * percent / 100) / 50)
    few = sized.where(F.col("k") <= FEW).groupBy("token").agg(F.collect_list(F.struct("node", "n")).alias("m"))
    pairs = few.select(F.explode(F.expr("flatten(transform(m, (x, i) -> transform(slice(m, i + 2, size(m)), y -> struct(least(x, y) as x, greatest(x, y) as y))))")).alias("p"))
    pairs = pairs.select(F.col("p.x.node").alias("a"), F.col("p.y.node").alias("b"), F.col("p.x.n").alias("na"), F.col("p.y.n").alias("nb"))
    pairs = pairs.where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)").groupBy("a", "b", "na", "nb").agg(F.count(F.lit(1)).alias("c"))
    many = cut(sized.where(F.col("k") > FEW), "many")
    held = many.groupBy("node").agg(F.count(F.lit(1)).alias("h"), F.max("n").alias("n"))
    side = lambda x: held.select(F.col("node").alias(x), F.col("h").alias(f"h{x}"))
    pairs = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
    enough = F.col("c") + F.least(F.coalesce("ha", F.lit(0)), F.coalesce("hb", F.lit(0))) >= F.greatest(floor(F.col("na")), floor(F.col("nb")))
    heavy = many.join(held.where(F.col("h") >= floor(F.col("n"))).select("node"), "node", "left_semi")
    star = heavy.groupBy("token").agg(F.min("node").alias("b"))
    near = cut(pairs.where(enough).select("a", "b").distinct(), "near")
    edges = near.union(heavy.join(star, "token").select(F.col("node").alias("a"), "b").distinct())
    cluster = cut(components(edges).withColumnRenamed("component", "cluster"), "clusters")

    def sets_of(nodes: DataFrame) -> DataFrame:
        """(node, seq) for the nodes and a few others; ids that repeat with other texts give several sets of one node."""
        marks = spark.sparkContext.broadcast(_marks(nodes))

        def whole(batches):
            for batch in batches:
                # most other rows go here; the join with the clusters drops the rest
                batch = batch.filter(batch.column("doc").is_valid())
                word, bit = _mark(batch.column("doc").to_numpy())
                batch = batch.filter(pa.array((marks.value[word] >> bit) & np.uint64(1) == 1))
                yield pa.RecordBatch.from_arrays([batch.column("doc"), _lists(list(doc_shingles(batch.column("text"), k)))], ["node", "seq"])

        return docs.mapInArrow(lean(whole), "node long, seq array<long>").where("size(seq) > 0")

    order = lambda x: level.value[(x >> np.uint64(64 - CELL_BITS)).astype(np.int64)]

    # a cluster within a block's bound is walked as a whole, so each set is sent once
    numbers = own.where("doc = node").groupBy("node").agg(F.max("n").alias("n"))
    weight = cluster.join(numbers, "node").groupBy("cluster").agg(F.sum("n").alias("w"))
    sized = cut(cluster.join(weight, "cluster"), "sized")
    small = sized.where(F.col("w") <= BLOCK).select("cluster", "node", F.col("node").alias("grp"))
    small = small.hint("merge").join(sets_of(small.select("node")), "node")  # grows with the corpus
    links = cut(small.select("cluster", "node", "grp", "seq").repartition("cluster").sortWithinPartitions("cluster").mapInArrow(lean(_blocks(1, percent, order)), LINKS), "links")
    large = sized.where(F.col("w") > BLOCK).select("node", "cluster", "w")
    # the buckets of a large cluster: each set with those it shares enough with, and the larger buckets
    meet = near.select(F.xxhash64(F.lit("near"), "a").alias("token"), F.explode(F.array("a", "b")).alias("node")).distinct()
    meet = meet.union(heavy.join(large, "node").select(F.xxhash64("cluster", "token").alias("token"), "node"))
    # a cluster of up to COARSE blocks is one bucket: that sends a set less often than once for each of its own
    coarse = large.where(F.col("w") <= COARSE * BLOCK)
    meet = meet.join(coarse.select("node"), "node", "left_anti").select("token", "node").union(coarse.select(F.xxhash64(F.lit("cluster"), "cluster").alias("token"), "node"))
    buckets = cut(meet.join(large.select("node"), "node", "left_semi").join(numbers, "node").select("token", "node", "n"), "buckets")
    if not buckets.isEmpty():
        sets = cut(sets_of(large.select("node")).join(large.select("node"), "node", "left_semi"), "sets")
        links = links.union(_large_clusters(buckets, sets, percent, order))
    # rows of one id are one document
    several = own.where("node is not null").groupBy("doc").agg(F.min("node").alias("b"), F.max("node").alias("hi")).where("b < hi").select("doc", "b")
    final = components(links.union(own.join(several, "doc").select(F.col("node").alias("a"), "b")))
    own = own.select("doc", "n", "node").join(final, "node", "left")
    whole_id = F.when(F.col("n") == 0, F.col("doc")).otherwise(F.coalesce("component", "node"))
    out = own.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("doc").isNotNull(), whole_id).alias("component_id"))
    drop(shared)
    return out
