"""Document fingerprints from Lempel-Ziv phrases.

A text is parsed into dictionary phrases as LZ78 does: each phrase is the shortest piece that the dictionary lacks, and joins it.
The phrases are hashed, and the smallest hashes are the fingerprint. Two texts that compress each other well share phrases, and
their fingerprints estimate the share of common phrases (Jaccard). As in LZW with a full table, the dictionary is emptied after
DICTIONARY phrases, so that memory is bounded for texts of any length; the phrases before still count.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tensorloom.llm.sharding import _mix

MINIMA = 256  # hashes of a fingerprint, eight hexadecimal digits each
DICTIONARY = 1 << 18
PIECE = 1 << 20  # code points that are hashed together
_BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []


def _powers() -> list[np.ndarray]:
    """Powers of the odd base and of its inverse modulo 2 ** 64."""
    if not _POWERS:
        for base in (_BASE, pow(_BASE, -1, 2**64)):
            p = np.full(PIECE + DICTIONARY + 2, base, np.uint64)
            p[0] = 1
            _POWERS.append(np.cumprod(p, dtype=np.uint64))
    return _POWERS


def _least(hashes: np.ndarray) -> np.ndarray:
    return np.unique(hashes)[:MINIMA]


class Parse:
    """The state of a parse: the dictionary, the phrase that has begun, and the smallest hashes so far."""

    def __init__(self):
        self.seen: dict[str, None] = {}
        self.begun = ""
        self.done = 0  # phrases of the dictionary whose hashes are taken
        self.minima = np.zeros(0, np.uint32)

    def fork(self) -> Parse:
        other = Parse()
        other.seen, other.begun, other.done, other.minima = self.seen.copy(), self.begun, self.done, self.minima
        return other

    def feed(self, text: str) -> Parse:
        for at in range(0, len(text), PIECE):
            seen, s = self.seen, self.begun
            for c in text[at : at + PIECE]:
                s += c
                if s not in seen:
                    seen[s] = None
                    s = ""
                    if len(seen) >= DICTIONARY:
                        self._take()
                        seen.clear()
                        self.done = 0
            self.begun = s
            self._take()
        return self

    def _take(self) -> None:
        """Hash the phrases that are new in the dictionary: polynomials of code points from running sums."""
        phrases = list(self.seen)[self.done :]
        self.done = len(self.seen)
        at = 0
        power, inverse = _powers()
        sizes = np.fromiter(map(len, phrases), np.int64, len(phrases))
        while at < len(phrases):
            ends = np.cumsum(sizes[at:])
            n = max(1, int(np.searchsorted(ends, PIECE, side="right")))
            ends = ends[:n]
            codes = np.frombuffer("".join(phrases[at : at + n]).encode("utf-32-le", "surrogatepass"), np.uint32)
            sums = np.zeros(len(codes) + 1, np.uint64)
            np.cumsum(_mix(codes.astype(np.uint64) + np.uint64(1)) * power[: len(codes)], out=sums[1:])
            starts = ends - sizes[at : at + n]
            h = _mix((sums[ends] - sums[starts]) * inverse[starts])
            self.minima = _least(np.concatenate([self.minima, (h >> np.uint64(32)).astype(np.uint32)]))
            at += n

    def fingerprint(self) -> str:
        return self.minima.astype(">u4").tobytes().hex()


def fingerprint(text: str | None) -> str:
    """The fingerprint of a text; null counts as empty, whose fingerprint is the empty string."""
    return Parse().feed(text or "").fingerprint()


def phrase_likeness(a: str, b: str) -> float:
    """Estimated share of common phrases of two fingerprints, 0 to 1: of the smallest hashes of both together, those that both have.
    Exact below MINIMA phrases; 1 for two empty ones."""
    x, y = (np.frombuffer(bytes.fromhex(f), ">u4").astype(np.int64) for f in (a, b))
    values, times = np.unique(np.concatenate([x, y]), return_counts=True)
    return float((times[:MINIMA] == 2).sum() / len(times[:MINIMA])) if len(values) else 1.0


def likeness(a: Column, b: Column) -> Column:
    """phrase_likeness of two columns; null where one is null."""

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else phrase_likeness(p, q) for p, q in zip(x, y, strict=True)], dtype="float64")

    return run(a, b)


def lz_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint) for each row of docs, in place: no shuffle. Null texts count as empty; ids may be null or repeat."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([fingerprint(t) for t in batch.column("text").to_pylist()], pa.string())], ["doc_id", "fingerprint"])

    return slim.mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, fingerprint string")


KINDS = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
COLUMNS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
OVERSAMPLED = 20  # sampled keys for each range


def _parsed(text: str, parts: int) -> tuple[Parse, str]:
    """The parse of the text without its last part, and the whole text's fingerprint."""
    n, k = len(text), len(text) // parts
    stem = Parse().feed(text[: n - k])
    return stem, (stem.fork().feed(text[n - k :]) if k else stem).fingerprint()


def _compared(text: str, stem: Parse, whole: str, after: str, after_print: str, parts: int) -> tuple:
    """The values of a row whose next text is `after`; stem, whole: what _parsed gave."""
    n, k = len(text), len(text) // parts
    edited = text[: n - k] + after[:k]
    other = stem.fork().feed(after[:k]).fingerprint() if k else whole
    return n, hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), whole, other, phrase_likeness(whole, other), phrase_likeness(whole, after_print)


def _bounds(keyed: DataFrame, ranges: int) -> list[tuple[int, int, int]]:
    """The first keys of about equal ranges: the least key of all, and some of a sample of about OVERSAMPLED keys a range. They
    are rows of the table, as many as there are ranges."""
    key = F.struct("k", "h", "s")
    share = min(1.0, OVERSAMPLED * ranges / max(1, keyed.count()))
    drawn = F.xxhash64(F.lit("sample"), "s", "h").bitwiseAND(F.lit(2**62 - 1)) < F.lit(int(share * 2**62))
    found = keyed.agg(F.min(key).alias("least"), F.collect_list(F.when(drawn, key)).alias("some")).first()
    if found.least is None:
        return []
    some = sorted(tuple(x) for x in found.some)
    step = max(1, len(some) // ranges)
    return sorted({tuple(found.least), *some[step::step]})


def compare_neighbours(docs: DataFrame, parts: int = 4, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None) -> DataFrame:
    """Each text's fingerprint beside that of an edit and of the next text, as a measure of what the fingerprint tells apart.

    The next row is that of the next larger id (rows of one id in the order of their texts' hashes, null ids first); after the last
    comes the first, so a single row is its own next one. The edit replaces the last floor(n / parts) code points by as many of
    the next text's first ones, or all if it is shorter. Rows: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next. Null texts count as empty; ids are whole numbers. docs are read three times and
    must then give the same rows in the same order, as tables do.

    Texts move once, into ranges of the id (`ranges`, else as many as the session's shuffle partitions), which are sorted. The first
    row of each range also closes the range before it, so that every row meets its next one where it lies.
    """
    who = F.col(id_col).cast("long")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = docs.select(who.alias("doc_id"), F.coalesce(who, F.lit(-(2**63)).cast("long")).alias("k"), text.alias("text"), F.xxhash64(text).alias("h"), F.monotonically_increasing_id().alias("s"))
    spark = docs.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = _bounds(keyed.select("k", "h", "s"), ranges)
    kind = [("k", np.int64), ("h", np.int64), ("s", np.int64)]
    bounds = np.array(found, kind)

    @F.pandas_udf("int")
    def place(k: pd.Series, h: pd.Series, s: pd.Series) -> pd.Series:
        keys = np.empty(len(k), kind)
        keys["k"], keys["h"], keys["s"] = k, h, s
        return pd.Series(np.searchsorted(bounds, keys, side="right") - 1)

    firsts = spark.createDataFrame([(*b, (i - 1) % len(found)) for i, b in enumerate(found)], "k long, h long, s long, part int")  # one row a range
    cols = ["part", "closing", "k", "h", "s", "doc_id", "text"]
    here = keyed.withColumns({"part": place("k", "h", "s"), "closing": F.lit(0)})
    closing = keyed.join(F.broadcast(firsts), ["k", "h", "s"]).withColumn("closing", F.lit(1))
    rows = here.select(*cols).union(closing.select(*cols)).repartition(max(1, len(found)), "part").sortWithinPartitions("part", "closing", "k", "h", "s")

    def run(batches):
        held = None  # id, text, parse of its stem, fingerprint
        for batch in batches:
            out = []
            for who, text, closes in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "closing")), strict=True):
                stem, whole = _parsed(text, parts)
                if held:
                    out.append((held[0], *_compared(*held[1:], text, whole, parts)))
                held = None if closes else (who, text, stem, whole)
            if out:
                kinds = [pa.int64(), pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], COLUMNS)

    return rows.select("doc_id", "text", "closing").mapInArrow(run, f"doc_id long, {KINDS}")
