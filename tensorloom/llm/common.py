"""What the operators share: the table folder, cut points, hashing of words and global ranks."""

from __future__ import annotations

import threading
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tensorloom.sources.shared import folder

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "2097152"
_lock, _users, _before = threading.Lock(), {}, {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


shared_dir = folder  # the folder all executors share, as the cluster names it


@contextmanager
def _setting(spark: SparkSession, key: str, value: str):
    """A setting of the session for what is run meanwhile. The session's own comes back when the last of several users that
    run at once is done."""
    with _lock:
        if not _users.get(key):
            _before[key] = spark.conf.get(key, None)
        _users[key] = _users.get(key, 0) + 1
        spark.conf.set(key, value)
    try:
        yield
    finally:
        with _lock:
            _users[key] -= 1
            if not _users[key]:
                own = _before.pop(key)
                spark.conf.unset(key) if own is None else spark.conf.set(key, own)


def _cleaning(spark: SparkSession):
    """Shuffle files of what is written meanwhile go as soon as it is written."""
    return _setting(spark, CLEANUP, "true")


def small_batches(spark: SparkSession):
    """Batches of two megabytes for Python, not of Spark's 64: an executor holds some of each running task, outside its heap."""
    return _setting(spark, BATCH, BATCH_BYTES)


def cut(df: DataFrame, what: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends here, and a lost executor costs no earlier work."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tensorloom/{spark.sparkContext.applicationId}/{what}-{uuid.uuid4().hex}"
    with _cleaning(spark):
        df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._tensorloom_path = path
    return back


def drop(df: DataFrame) -> None:
    """Delete a table that cut() wrote and nothing reads any more."""
    path = getattr(df, "_tensorloom_path", None)
    if path:
        jvm, jsc = df.sparkSession._jvm, df.sparkSession.sparkContext._jsc
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(jsc.hadoopConfiguration()).delete(where, True)


HOT = 1000


def with_hot(rows: DataFrame, groups: DataFrame, key: str | list[str], size: str, total: int) -> DataFrame:
    """rows joined with their group by key; groups has one row for each key, with the number of its rows in `size`.

    Groups of more than a HOT-th of the `total` rows, which are fewer than HOT, are broadcast and leave their rows where they
    are. The others are joined by a shuffle, in which no key has more rows than that. Both tables are read twice.
    """
    key = [key] if isinstance(key, str) else key
    hot = groups.where(F.col(size) * HOT > total)
    rest = rows.join(F.broadcast(hot.select(*key)), key, "left_anti").join(groups.where(F.col(size) * HOT <= total), key)
    return rows.join(F.broadcast(hot), key).unionByName(rest)


_A, _B, _S = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(29)


def chain(parts: list[np.ndarray]) -> np.ndarray:
    """One hash for each row of equally long columns of hashes; the order of the columns counts."""
    h = np.full(len(parts[0]), len(parts), np.uint64)
    for part in parts:
        h = (h ^ part) * _A
        h ^= h >> _S
        h *= _B
        h ^= h >> _S
    return h


_BASE, _PIECE = 0xD6E8FEB86659FD93, 250_000
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_POWERS: list = []


def _tables():
    """Powers of the odd base and of its inverse modulo 2 ** 64, and a random number for each lower-cased byte."""
    if not _POWERS:
        for base in (_BASE, pow(_BASE, -1, 2**64)):
            p = np.full(_PIECE + 1, base, np.uint64)
            p[0] = 1
            _POWERS.append(np.cumprod(p, dtype=np.uint64))
        _POWERS.append(np.random.default_rng(11).integers(1, 2**64, 256, np.uint64)[_LOWER])
    return _POWERS


def _words(b: np.ndarray, starts: np.ndarray):
    """Of the words in at most _PIECE bytes: polynomials of their bytes, first and last place; no word goes over a start."""
    n = len(b)
    power, inverse, value = _tables()
    solid = ~_SPACE[b]
    edge = np.zeros(n + 1, bool)
    edge[starts] = True
    before, after = np.empty(n, bool), np.empty(n, bool)
    if n:
        before[0], after[-1] = False, False
        before[1:], after[:-1] = solid[:-1], solid[1:]
    begin = np.flatnonzero(solid & (~before | edge[:n]))
    end = np.flatnonzero(solid & (~after | edge[1:])) + 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(value[b] * power[:n], out=sums[1:])
    return (sums[end] - sums[begin]) * inverse[begin], begin, end


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _A
    return h ^ (h >> _S)


def _long_row(b: np.ndarray) -> np.ndarray:
    """Word hashes of one long text, piece by piece; a word that goes on in the next piece is carried over."""
    parts, carried, length = [], None, 0
    for at in range(0, len(b), _PIECE):
        piece = b[at : at + _PIECE]
        h, begin, end = _words(piece, np.array([0, len(piece)]))
        lengths = end - begin
        if carried is not None:
            if len(begin) and begin[0] == 0:
                h[:1] = carried + h[:1] * np.uint64(pow(_BASE, length, 2**64))
                lengths[0] += length
            else:
                parts.append(carried)
            carried = None
        if len(end) and end[-1] == len(piece):
            carried, length, h = h[-1:], int(lengths[-1]), h[:-1]
        parts.append(h)
    if carried is not None:
        parts.append(carried)
    return _mixed(np.concatenate(parts))


def word_hashes(column: pa.Array):
    """For stretches of rows of a text column (first row, hashes of all words, words of each row).

    Words are [^\x20\x09-\x0D]+ after lower-casing A-Z; null counts as empty. A stretch has up to _PIECE bytes, or one longer
    row, which is read in pieces. The hash is a polynomial of random byte values with a final mix, taken from running sums
    over the bytes.
    """
    if len(column) == 0:
        return
    column = column.fill_null("") if column.null_count else column
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    at = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(at, at[first] + _PIECE, side="right")) - 1)
        b, starts = data[at[first] : at[last]], at[first : last + 1] - at[first]
        if len(b) > _PIECE:
            h = _long_row(b)
            yield first, h, np.array([len(h)])
        else:
            h, begin, _ = _words(b, starts)
            yield first, _mixed(h), np.diff(np.searchsorted(begin, starts))
        first = last


def doc_shingles(column: pa.Array, k: int):
    """The distinct k-word shingles of each row as sorted 64-bit hashes; fewer words make one shingle of the whole sequence,
    none make none."""
    for _, words, counts in word_hashes(column):
        ends = np.cumsum(counts)
        windows = chain([words[i : len(words) - k + 1 + i] for i in range(k)]) if len(words) >= k else words[:0]
        for end, n in zip(ends.tolist(), counts.tolist(), strict=True):
            if n >= k:
                s = np.sort(windows[end - n : end - k + 1])
                fresh = np.empty(len(s), bool)
                fresh[0] = True
                np.not_equal(s[1:], s[:-1], out=fresh[1:])
                yield s[fresh]
            elif n:
                yield chain([words[i : i + 1] for i in range(end - n, end)])
            else:
                yield words[:0]


def ranked(df: DataFrame, keys: list[str | Column], rank: str) -> DataFrame:
    """df with the global number of each row in the order of keys, 0 up without gaps.

    Ranges of the keys are sorted in parallel; only the row count of each range comes to the driver. The sorted rows are
    cut, so the numbers can't change when a task runs again. Rows with equal keys get consecutive numbers.
    """
    spark = df.sparkSession
    at = F.monotonically_increasing_id()
    rows = cut(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__at", at), "ranked")
    part = F.shiftright("__at", 33)
    counts = sorted(rows.groupBy(part.alias("p")).count().collect())
    offsets, total = [], 0
    for p, n in counts:
        offsets.append((p, total))
        total += n
    schema = T.StructType([T.StructField("__p", T.LongType()), T.StructField("__off", T.LongType())])
    starts = spark.createDataFrame(offsets, schema)  # one row for each range
    out = rows.withColumn("__p", part).join(F.broadcast(starts), "__p")
    return out.withColumn(rank, F.col("__off") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).drop("__p", "__off", "__at")
