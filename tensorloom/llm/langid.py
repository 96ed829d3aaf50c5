"""Language identification by n-gram filters whose slots hold a bitmask of languages.

A slot of the table has one bit for each language, in as many 64-bit words as they need (bit-sliced Bloom filters: one lookup asks all of them). An n-gram's
languages are the bitwise "and" of its slots. A text's n-grams are popcounted for each language, the counts corrected for
the share that the filter's fill would let through by chance, and the highest corrected rate decides.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tensorloom.llm.common import cut
from tensorloom.llm.sharding import _mix
from tensorloom.llm.tokens import batches_of, kept, release

SIZES = (2, 3, 4)
SLOT_BITS, HASHES = 18, 2
UND = "und"
LONG = 4096  # characters; stretches without white space count as words of this length


def words_of(text: str) -> list[str]:
    out = text.lower().split()
    if any(len(w) > LONG for w in out):
        out = [w[i : i + LONG] for w in out for i in range(0, len(w), LONG)]
    return out


def letters(codes: np.ndarray) -> np.ndarray:
    """Whether each code point is a letter (Unicode category L)."""
    distinct, place = np.unique(codes, return_inverse=True)
    return np.fromiter((chr(c).isalpha() for c in distinct.tolist()), bool, len(distinct))[place]


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of all words, each word between two spaces, and the word of each. Other characters than letters
    count as spaces; n-grams of spaces alone are left out."""
    joined = " ".join(words)
    codes = np.frombuffer(f" {joined} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.cumsum([0, *(len(w) + 1 for w in words)])[:-1]
    good = letters(codes)
    c = np.where(good, codes, 32).astype(np.uint64)
    owner = np.zeros(len(c), np.int64)
    owner[starts[1:]] = 1
    owner = np.cumsum(owner)
    hashes, whose = [], []
    for n in SIZES:
        if len(c) < n:
            continue
        h, any_ = np.full(len(c) - n + 1, n, np.uint64), np.zeros(len(c) - n + 1, bool)
        for i in range(n):
            h = h * np.uint64(0x100000001B3) + c[i : len(c) - n + 1 + i]
            any_ |= good[i : len(c) - n + 1 + i]
        # inside one word and its two spaces
        last = np.minimum(np.arange(n - 2, len(c) - 1), len(c) - 1)[: len(h)]
        fits = any_ & (owner[: len(h)] == owner[last])
        hashes.append(_mix(h[fits]))
        whose.append(owner[: len(h)][fits])
    if not hashes:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(hashes), np.concatenate(whose)


@dataclass
class Filters:
    languages: list[str]
    table: np.ndarray  # words of 64 languages by slots: bitmasks of languages

    def __post_init__(self):
        fill = [self._bit(self.table, i).mean() for i in range(len(self.languages))]
        self.chance = np.array(fill, np.float64) ** HASHES  # of an n-gram outside

    @staticmethod
    def _bit(masks: np.ndarray, language: int) -> np.ndarray:
        return (masks[language // 64] >> np.uint64(language % 64)) & np.uint64(1)

    @classmethod
    def of(cls, languages: list[str], grams_of: list[tuple[int, int]]) -> Filters:
        """grams_of: (hash as signed 64-bit number, bitmask of any size)."""
        table = np.zeros((max(1, -(-len(languages) // 64)), 1 << SLOT_BITS), np.uint64)
        if grams_of:
            h = np.array([g for g, _ in grams_of], np.int64).view(np.uint64)
            for word, row in enumerate(table):
                mask = np.array([m >> 64 * word & 2**64 - 1 for _, m in grams_of], np.uint64)
                for at in cls._slots(h):
                    np.bitwise_or.at(row, at, mask)
        return cls(languages, table)

    @staticmethod
    def _slots(h: np.ndarray):
        for i in range(HASHES):
            yield ((h >> np.uint64(i * SLOT_BITS)) & np.uint64((1 << SLOT_BITS) - 1)).astype(np.int64)

    def masks(self, h: np.ndarray) -> np.ndarray:
        """A row for each word of the table."""
        out = np.full((len(self.table), len(h)), 2**64 - 1, np.uint64)
        for at in self._slots(h):
            for row, word in zip(out, self.table, strict=True):
                row &= word[at]
        return out

    def counts(self, words: list[str]) -> np.ndarray:
        """For each word: n-grams of each language, all n-grams, and letters (a row each)."""
        h, whose = grams(words)
        masks, n = self.masks(h), len(words)
        cols = [np.bincount(whose, weights=self._bit(masks, i), minlength=n) for i in range(len(self.languages))]
        cols.append(np.bincount(whose, minlength=n))
        cols.append(np.fromiter((any(map(str.isalpha, w)) for w in words), bool, n))
        return np.stack(cols, axis=1).astype(np.float64)

    def decide(self, sums: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Languages and scores for rows of summed counts."""
        k = len(self.languages)
        total = np.maximum(sums[:, k], 1)[:, None]
        rate = np.clip((sums[:, :k] / total - self.chance) / np.maximum(1 - self.chance, 1e-9), 0, 1)
        if not k:
            return [UND] * len(sums), np.zeros(len(sums))
        best = rate.argmax(axis=1)
        score = rate[np.arange(len(sums)), best]
        score[sums[:, k + 1] == 0] = 0
        return [self.languages[b] if n else UND for b, n in zip(best, sums[:, k + 1], strict=True)], score


def fit(labelled: DataFrame, per_language: int = 1000, min_rate: float = 2e-5, min_share: float = 0.4, id_col: str = "doc_id") -> Filters:
    """Filters from (text, lang) rows; rows without either are left out. Every lang value is learned.

    From each language at most about `per_language` whole texts are taken, those with the smallest hash of id and text, so that rows
    that share or lack an id are drawn apart; rows that repeat both are drawn together. An
    n-gram belongs to each language where it makes at least min_rate of all n-grams and at least min_share of its highest
    rate in any language, so a language has at most 1 / min_rate of them, and no more come to the driver.
    """
    spark = labelled.sparkSession
    rows = labelled.where("text is not null and lang is not null").select(F.col(id_col).alias("id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    sizes = sorted(((r["lang"], r["n"]) for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()))
    if not sizes:
        return Filters.of([], [])
    languages = [lang for lang, _ in sizes]
    share = spark.createDataFrame([(lang, min(1.0, per_language / n)) for lang, n in sizes], "lang string, share double")  # a row for each language
    draw = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.join(F.broadcast(share), "lang").where(draw <= F.col("share")).select("lang", "text")
    number = {lang: i for i, lang in enumerate(languages)}

    def count(batches):
        release()
        sums: dict[int, dict[int, int]] = {}

        def flush():
            for i, found in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(found), pa.int32()), pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())], ["lang", "gram", "n"])
            sums.clear()

        for batch in batches:
            langs, texts = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
            for some in batches_of(texts, 500_000):
                for lang in {langs[i] for i, _ in some}:
                    into = sums.setdefault(number[lang], {})
                    for part in batches_of([w for i, t in some if langs[i] == lang for w in words_of(t)], 500_000):
                        h, n = np.unique(grams([w for _, w in part])[0].view(np.int64), return_counts=True)
                        for a, b in zip(h.tolist(), n.tolist(), strict=True):
                            into[a] = into.get(a, 0) + b
                if sum(map(len, sums.values())) > 150_000:
                    yield from flush()
        yield from flush()

    counted = cut(sample.mapInArrow(count, "lang int, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    totals = counted.groupBy("lang").agg(F.sum("n").alias("total"))  # a row for each language
    rated = counted.join(F.broadcast(totals), "lang").select("lang", "gram", (F.col("n") / F.col("total")).alias("rate"))
    kept = rated.where(F.col("rate") >= min_rate).toPandas()
    kept = kept[kept.rate >= min_share * kept.groupby("gram").rate.transform("max")]
    masks: dict[int, int] = {}
    for gram, lang in zip(kept.gram.tolist(), kept.lang.tolist(), strict=True):
        masks[gram] = masks.get(gram, 0) | 1 << lang
    return Filters.of(languages, sorted(masks.items()))


class _Words:
    """Counts of words; about `most` distinct words and `most_chars` characters of them are remembered, fewer words where there
    are more than 64 languages, and what one batch adds."""

    def __init__(self, filters: Filters, most: int = 150_000, most_chars: int = 8_000_000):
        self.filters, self.most, self.most_chars, self.place, self.chars = filters, most // len(filters.table), most_chars, {}, 0
        self.rows = np.empty((0, len(filters.languages) + 2), np.float32)

    def sums(self, texts: list[str]) -> np.ndarray:
        if len(self.place) > self.most or self.chars > self.most_chars:
            self.place, self.rows, self.chars = {}, self.rows[:0], 0
        split = [words_of(t) for t in texts]
        new = sorted({w for words in split for w in words if w not in self.place})
        if new:
            self.place.update(zip(new, range(len(self.rows), len(self.rows) + len(new)), strict=True))
            self.chars += sum(map(len, new))
            counts = [self.filters.counts([w for _, w in some]).astype(np.float32) for some in batches_of(new, 1_000_000)]
            self.rows = np.concatenate([self.rows, *counts])
        out = np.zeros((len(texts), self.rows.shape[1]))
        for i, words in enumerate(split):
            if words:
                at = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))
                n = np.bincount(at) if len(self.rows) < 4 * len(at) else None
                out[i] = n @ self.rows[: len(n)] if n is not None else self.rows[at].sum(axis=0)
        return out


def identify(docs: DataFrame, filters: Filters, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score (0 to 1): all columns stay, older columns of these two names go.

    Null text, empty text and text without a letter give "und" with score 0. A text with letters gets a learned language
    always, the first in alphabetical order among equals; its score is the corrected share of its n-grams. Stretches without
    white space count as words of LONG characters, so memory stays bounded.
    """
    docs = docs.drop("lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast((filters.languages, filters.table))  # 2 ** SLOT_BITS masks for each 64 languages, whatever the corpus
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches):
        filters = Filters(*shared.value)
        # of a fit: the next one gets its own words
        words = kept(("words", hash(filters.table.tobytes())), lambda: _Words(filters))
        for batch in batches:
            texts = [t or "" for t in batch.column(text_col).to_pylist()]
            sums = [words.sums([t for _, t in some]) for some in batches_of(texts, 1_000_000)]
            sums = np.concatenate(sums) if sums else np.empty((0, len(filters.languages) + 2))
            langs, scores = filters.decide(sums)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, schema)
