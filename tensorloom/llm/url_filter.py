"""URL filters by a Bloom filter cascade.

Level 0 holds the listed keys. Keys of the corpus that are not listed but pass level 0 go into level 1, listed keys that
pass level 1 into level 2, and so on until a level lets nothing wrong through. A key of the corpus is listed exactly when
the first level that it fails is odd. The cascade is exact over the complete key universe of the corpus, small enough for
every task, and needs no join.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tensorloom.llm.sharding import _mix


class Bloom:
    def __init__(self, keys: np.ndarray, bits_per_key: float, hashes: int, salt: int, least: int = 64):
        self.m, self.hashes, self.salt = max(least, int(len(keys) * bits_per_key)), hashes, salt
        self.bits = np.zeros((self.m + 7) // 8, np.uint8)
        for at in self._at(keys):
            np.bitwise_or.at(self.bits, at >> 3, (1 << (at & 7)).astype(np.uint8))

    def parts(self) -> tuple:
        return self.m, self.hashes, self.salt, self.bits

    @classmethod
    def of(cls, parts: tuple) -> Bloom:
        out = cls.__new__(cls)
        out.m, out.hashes, out.salt, out.bits = parts
        return out

    def _at(self, keys: np.ndarray):
        base = keys.view(np.uint64)
        for i in range(self.hashes):
            yield (_mix(base + np.uint64((self.salt * 64 + i + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))) % np.uint64(self.m)).astype(np.int64)

    def has(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for at in self._at(keys):
            out &= (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        return out


FIRST = 1 << 20  # bits of the first level at least


class Cascade:
    """Keys are 64-bit hashes. wrong: gives, for a test of hashes, the keys outside the list that pass it (a set no larger
    than the list's share of false positives)."""

    def __init__(self, listed: np.ndarray, wrong, first_bits: float = 24, most_levels: int = 64):
        self.levels: list[Bloom] = []
        inside, outside = listed, None
        while len(self.levels) < most_levels:
            first = not self.levels
            self.levels.append(Bloom(inside, first_bits if first else 3, 8 if first else 2, len(self.levels), FIRST if first else 64))
            outside = wrong(self.levels[0].has) if first else outside[self.levels[-1].has(outside)]
            if not len(outside):
                return
            inside, outside = outside, inside
        raise ValueError("the cascade doesn't end: a key is both listed and not")

    def parts(self) -> list[tuple]:
        return [level.parts() for level in self.levels]

    @classmethod
    def of(cls, parts: list[tuple]) -> Cascade:
        out = cls.__new__(cls)
        out.levels = [Bloom.of(p) for p in parts]
        return out

    def has(self, keys: np.ndarray) -> np.ndarray:
        """Whether keys of the universe are listed."""
        out, open_ = np.zeros(len(keys), bool), np.ones(len(keys), bool)
        for i, level in enumerate(self.levels):
            passed = np.zeros(len(keys), bool)
            passed[open_] = level.has(keys[open_])
            out[open_ & ~passed] = i % 2 == 1
            open_ &= passed
        out[open_] = len(self.levels) % 2 == 1
        return out


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def key(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    host = F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _candidates(lengths: list[int], labels: int) -> Column:
    """Host suffixes at label borders, of up to the labels that rules have, with all beginnings of the path of the lengths that rules have.

    A space keeps host and path apart; "://" ends before a host, so no host that a rule can name has one.
    """
    suffixes = f"transform(sequence(1, least({labels}, size(split(host, '[.]', -1)))), i -> substring_index(host, '.', -i))"
    lens = ", ".join(map(str, lengths)) or "0"
    starts = f"transform(filter(array({lens}), l -> l <= length(path)), l -> substring(path, 1, l))"
    return F.expr(f"flatten(transform({suffixes}, h -> transform({starts}, p -> concat(h, ' ', p))))")


def url_filter(pages: DataFrame, rules: list[Rule], default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict) for each row of pages.

    Host: after the first "://" up to "/", "?", "#" or the end, A-Z lower-cased; path: from there up to "?", "#" or the
    end; both empty for null and without "://". A rule fits its host and all its subdomains if the path starts with its
    path; the longest host plus path wins, among equals the longer host. rule is null and the verdict `default` where none
    fits. The corpus's keys, the host suffixes with the beginnings of the path that have a rule's number of labels and length,
    are the cascade's universe. Rules with the same key must agree. Ids may repeat or be null; other columns are ignored.
    """
    if len({r.key for r in rules}) != len({(r.key, r.verdict) for r in rules}):
        raise ValueError("rules contradict each other")
    spark = pages.sparkSession
    url = F.col(url_col).cast("string")
    slim = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    keys = _candidates(sorted({len(r.path) for r in rules}), max([1, *(r.host.count(".") + 1 for r in rules)]))
    slim = slim.withColumn("keys", F.when(F.col("host") != "", keys).otherwise(F.expr("array()").cast("array<string>")))
    slim = slim.withColumn("hashes", F.transform("keys", lambda k: F.xxhash64(k)))
    spelled = {f"{r.host} {r.path}": r for r in rules}
    hashed = {row[0]: row[1] for row in spark.createDataFrame([(k,) for k in spelled] or [("",)], "k string").select("k", F.xxhash64("k")).collect()}
    listed = np.array([hashed[k] for k in spelled], np.int64)
    universe = slim.select(F.explode("hashes").alias("h"))

    def wrong(has):
        first = has.__self__.parts()

        def run(batches):
            bloom = Bloom.of(first)
            for batch in batches:
                h = batch.column(0).to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(h[bloom.has(h) & ~np.isin(h, listed)])], ["h"])

        # false positives of level 0 only, before anything is shuffled: about 1e-5 of the universe at 24 bits a key, and with few
        # rules next to none at FIRST bits
        return np.array([r[0] for r in universe.mapInArrow(run, "h long").distinct().collect()], np.int64)

    member = Cascade(listed, wrong)
    blocked = np.array([hashed[k] for k, r in spelled.items() if r.verdict == "block"], np.int64)
    allowed = np.array([hashed[k] for k, r in spelled.items() if r.verdict != "block"], np.int64)
    # verdicts by a second cascade, whose universe is the listed keys
    block = Cascade(blocked, lambda has: allowed[has(allowed)])
    cascades = spark.sparkContext.broadcast((member.parts(), block.parts()))

    def judge(batches):
        is_member, is_block = map(Cascade.of, cascades.value)
        for batch in batches:
            hashes = batch.column("hashes")
            flat, ends = hashes.flatten().to_numpy(), np.cumsum(pa.compute.list_value_length(hashes).to_numpy())
            good = is_member.has(flat)
            at = np.flatnonzero(good)
            row = np.searchsorted(ends, at, side="right")
            spelt = batch.column("keys").flatten().take(pa.array(at)).to_pylist()
            verdicts = is_block.has(flat[at])
            best: dict[int, tuple] = {}
            for r, key, v in zip(row.tolist(), spelt, verdicts.tolist(), strict=True):
                host, path = key.split(" ", 1)
                best[r] = max(best.get(r, (-1, -1, "", "")), (len(host) + len(path), len(host), host + path, "block" if v else "allow"))
            n = batch.num_rows
            out = [best.get(i) for i in range(n)]
            cols = [batch.column(c) for c in ("page_id", "host", "path")]
            cols += [pa.array([b and b[2] for b in out], pa.string()), pa.array([b[3] if b else default for b in out], pa.string())]
            yield pa.RecordBatch.from_arrays(cols, ["page_id", "host", "path", "rule", "verdict"])

    kind = slim.schema["page_id"].dataType.simpleString()
    return slim.select("page_id", "host", "path", "keys", "hashes").mapInArrow(judge, f"page_id {kind}, host string, path string, rule string, verdict string")
