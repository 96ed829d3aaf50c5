"""Packing token sequences into windows: non-negative least squares over shallow length combinations.

Documents become token ids with an end id and are cut into full windows and one remainder. Remainders are counted by size
class. Combinations of up to three (by `depth`) classes that fill a window exactly are the columns of a matrix; how often each is used is
the non-negative least squares solution against the counts, rounded down. What remains is packed greedily, counted by
class. The plan depends on at most a few hundred counts, so it is solved once on the driver; each piece then finds its
sequence from its number within its class, which needs neither a sort of a class nor all its pieces in one task.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tensorloom.llm.common import cut
from tensorloom.llm.tokens import ChunkEncoder, batches_of, kept

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, cls int, part int, local long"


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """x >= 0 with least |a x - b|, by the active-set method of Lawson and Hanson."""
    m, n = a.shape
    x, passive = np.zeros(n), np.zeros(n, bool)
    gram, proj = a.T @ a, a.T @ b
    scale = 1e-9 * max(1.0, np.abs(proj).max(initial=0))
    for _ in range(rounds):
        gradient = proj - gram @ x
        gradient[passive] = -np.inf
        j = int(np.argmax(gradient))
        if gradient[j] <= scale:
            break
        passive[j] = True
        while True:
            at = np.flatnonzero(passive)
            s = np.linalg.lstsq(gram[np.ix_(at, at)], proj[at], rcond=None)[0]
            if (s > 0).all():
                x[:] = 0
                x[at] = s
                break
            low = s <= 0
            old = x[at]
            step = np.min(old[low] / np.maximum(old[low] - s[low], 1e-300))
            x[at] = np.maximum(old + step * (s - old), 0)
            drop = at[low & (x[at] <= 1e-12 * max(1.0, x.max()))]
            passive[drop if len(drop) else at[int(np.argmin(s))]] = False
            x[~passive] = 0
    return x


def combinations(classes: list[int], window: int, depth: int) -> list[tuple[int, ...]]:
    """Up to `depth` class sizes, falling, that add up to the window."""
    found, have = [], set(classes)

    def walk(chosen, rest, top):
        if rest == 0:
            found.append(tuple(chosen))
        elif len(chosen) == depth - 1:
            if rest in have and rest <= top:
                found.append((*chosen, rest))
        else:
            for c in classes:
                if c <= min(rest, top):
                    walk([*chosen, c], rest - c, c)

    walk([], window, window)
    return list(dict.fromkeys(found))


def plan(counts: dict[int, int], window: int, depth: int = 3, shallow_from: int = 128, step: int = 64) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Patterns and their repeats that take exactly counts[size] pieces of each size; a pattern is ((size, pieces), ...).

    Combinations use classes of multiples of `step` from shallow_from up: a piece counts there as the next multiple.
    """
    left = {s: n for s, n in counts.items() if n > 0}
    coarse: dict[int, list[int]] = {}
    for s in sorted(left):
        if shallow_from <= s:
            coarse.setdefault(-(-s // step) * step, []).append(s)
    out: list = []
    sizes = sorted(coarse)
    combos = combinations(sizes, window, depth) if sizes else []
    if combos:
        row = {s: i for i, s in enumerate(sizes)}
        a, b = np.zeros((len(sizes), len(combos))), np.array([sum(left[s] for s in coarse[c]) for c in sizes], float)
        for j, combo in enumerate(combos):
            for c in combo:
                a[row[c], j] += 1
        weight = np.sqrt(np.array(sizes, float))  # long pieces are harder to place
        repeats = np.floor(nnls(a * weight[:, None], b * weight) + 1e-6).astype(np.int64)
        for j in np.argsort(-repeats, kind="stable"):
            times = int(repeats[j])
            while times > 0:  # fill the classes from their real sizes, the largest first
                need: dict[int, int] = {}
                spelled: dict[int, int] = {}
                for c in combos[j]:
                    s = next((s for s in reversed(coarse[c]) if left.get(s, 0) - spelled.get(s, 0) > 0), None)
                    if s is None:
                        break
                    spelled[s] = spelled.get(s, 0) + 1
                    need[c] = need.get(c, 0) + 1
                else:
                    n = min(times, *(left[s] // k for s, k in spelled.items()))
                    out.append((tuple(sorted(spelled.items(), reverse=True)), n))
                    for s, k in spelled.items():
                        left[s] -= n * k
                    times -= n
                    continue
                break
    # small pieces fill the room that combinations leave, then the rest is packed greedily, largest first
    filled = []
    for pattern, n in out:
        room = window - sum(s * k for s, k in pattern)
        while n:
            add: dict[int, int] = {}
            r, times = room, n
            for s in sorted((s for s, v in left.items() if v > 0 and s <= r), reverse=True):
                if s <= r and (k := min(r // s, left[s])):
                    add[s], r = k, r - s * k
                if not r:
                    break
            times = min([n, *(left[s] // k for s, k in add.items())])
            for s, k in add.items():
                left[s] -= times * k
            merged = dict(pattern)
            for s, k in add.items():
                merged[s] = merged.get(s, 0) + k
            filled.append((tuple(sorted(merged.items(), reverse=True)), times))
            n -= times
    while any(left.values()):
        spelled, r = {}, window
        for s in sorted((s for s, v in left.items() if v > 0), reverse=True):
            if s <= r and (k := min(r // s, left[s])):
                spelled[s], r = k, r - s * k
        times = min(left[s] // k for s, k in spelled.items())
        for s, k in spelled.items():
            left[s] -= times * k
        filled.append((tuple(sorted(spelled.items(), reverse=True)), times))
    return filled


def pack(docs: DataFrame, tokenizer_path: str, end_id: int, window: int = 4096, step: int = 16, fine: int = 128, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) for each piece of each row of docs.

    A document: its ids and then end_id; null text has only that. It is cut into full windows and a remainder. Lengths up to
    `fine` are classes of their own, longer ones round up to multiples of `step`; pieces lie without gaps in a sequence, so
    at most step - 1 tokens a piece are lost to rounding. Sequences are padded to the window except where their length is
    a power of two. Rows that repeat an id, and null ids, are packed as documents of their own. No rows: no pieces.
    """
    if window % step or fine % step:
        raise ValueError("step must divide window and fine")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def pieces(batches):
        encoder, part, local = kept(("ids", tokenizer_path), lambda: ChunkEncoder(tokenizer_path)), TaskContext.get().partitionId(), np.zeros(window + 1, np.int64)
        for batch in batches:
            ids_of = batch.column("doc_id").to_pylist()
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for some in batches_of(texts, 2_000_000):
                rows = []
                for (i, _), ids in zip(some, encoder.encode([t for _, t in some]), strict=True):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    for start in range(0, len(ids), window):
                        piece = ids[start : start + window]
                        n = len(piece)
                        cls = n if n <= fine else -(-n // step) * step
                        rows.append((ids_of[i], start, n, zlib.crc32(piece.tobytes()), len(ids), cls, part, int(local[cls])))
                        local[cls] += 1
                yield pa.RecordBatch.from_pydict({c.split()[0]: [r[j] for r in rows] for j, c in enumerate(PIECES.split(", "))}, pa.schema([(c.split()[0], pa.int32() if c.endswith("int") else pa.int64()) for c in PIECES.split(", ")]))

    cut_up = cut(docs.mapInArrow(pieces, PIECES), "pieces")
    per_part = cut_up.groupBy("cls", "part").agg(F.count(F.lit(1)).alias("n"))  # a row for each class and task
    before = F.sum("n").over(Window.partitionBy("cls").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = per_part.select("cls", "part", F.coalesce(before, F.lit(0)).alias("before"))
    counts = {r["cls"]: r["n"] for r in per_part.groupBy("cls").agg(F.sum("n").alias("n")).collect()}  # a row for each class
    patterns = plan(counts, window, step=max(step, window // 64))
    # for each class the runs of its numbers: where a pattern begins, how many of a sequence it takes, the first sequence
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    taken: dict[int, int] = {}
    base = 0
    for pattern, times in patterns:
        slot = 0
        for cls, k in pattern:
            runs.setdefault(cls, []).append((taken.get(cls, 0), k, base, slot))
            taken[cls] = taken.get(cls, 0) + k * times
            slot += k
        base += times
    table = {cls: np.array(r, np.int64).T for cls, r in runs.items()}
    shared = docs.sparkSession.sparkContext.broadcast(table)  # a row for each class and pattern

    def seat(batches):
        for batch in batches:
            cls, number = batch.column("cls").to_numpy(), batch.column("number").to_numpy()
            seq, slot = np.zeros(len(cls), np.int64), np.zeros(len(cls), np.int64)
            for c in np.unique(cls):
                at = np.flatnonzero(cls == c)
                begin, k, first, place = shared.value[int(c)]
                j = np.searchsorted(begin, number[at], side="right") - 1
                inside = number[at] - begin[j]
                seq[at], slot[at] = first[j] + inside // k[j], place[j] + inside % k[j]
            keep = [batch.column(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(seq), pa.array(slot)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "slot"])

    columns = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, slot long"
    numbered = cut_up.join(starts, ["cls", "part"]).withColumn("number", F.col("before") + F.col("local"))
    seated = numbered.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "cls", "number").mapInArrow(seat, columns)
    inside = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return seated.select(*[c.split()[0] for c in columns.split(", ")[:6]], F.coalesce(F.sum("length").over(inside), F.lit(0)).alias("offset"))
