"""Alignment of two tokenizers' tokens by byte-owner arrays.

Both token sequences cover the same bytes. np.repeat puts on each byte the number of the token of A and of the token of B that own
it. Where the pair of owners changes, another overlap begins; where both change at once, both tokenizations are cut, and the
tokens between two cuts form a group. Many texts lie one after the other in the same arrays; very long ones are cut into pieces
where both tokenizers part words.

How many documents hold two ids linked is counted in blocks of documents: a block lists its distinct pairs once, with the number
of its documents. These lists, which are far shorter than the links, are what Spark groups and joins.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tensorloom.llm.common import cut
from tensorloom.llm.tokens import kept

WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"  # White_Space of Unicode
#: Before a space that follows a character that isn't white A's splitter cuts, and a word of B starts.
SEAM = regex.compile(rf"(?<=[^{WHITE}])(?= )")
#: Characters that every version of Unicode puts into the same classes.
SETTLED = regex.compile(r"[\t\n\r\x20-\x7e\u00a1-\u00ac\u00ae-\u024f\u2010-\u2027]*+").fullmatch
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # the pattern of byte-level BPE
BLOCK = 2_000_000  # bytes of the documents of a block
PIECE = 1_000_000  # characters of a text that are encoded together
DOC = "block long, doc_id {id}, n_a long, n_b long, n_groups long, n_overlaps long, n_links long, groups string"
LINKS = "pair array<int>, times array<int>, pairs array<struct<a:int,b:int,docs:int>>"


def pieces(text: str, most: int = PIECE) -> list[str]:
    """The text in pieces of about `most` characters that both tokenizers treat alone; longer where there is no seam."""
    out, start = [], 0
    while len(text) - start > most and (seam := SEAM.search(text, start + most)):
        out.append(text[start : seam.start()])
        start = seam.start()
    return [*out, text[start:]]


def _listed(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte strings as one array, with where each begins and how long it is."""
    size = np.array([len(p) for p in parts], np.int64)
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum(size) - size, size


def _taken(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The stretches of data that begin there and have these sizes, one after the other."""
    ends = np.cumsum(size)
    return data[np.repeat(begin - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)]


class Aligner:
    """The two tokenizers, and tables of their tokens' bytes."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        with open(a_path, encoding="utf-8") as f:
            splitter = json.load(f)["pre_tokenizer"]
        if (splitter["type"], splitter["add_prefix_space"], splitter["use_regex"]) != ("ByteLevel", False, True):
            raise ValueError("only byte-level tokenizers that split by their own pattern are supported")
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        if self.b.encode("a") == self.b.encode(" a"):
            raise ValueError("the model must put a space before a text and keep its spaces")
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # bytes that stand for themselves
        of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        vocab = self.a.get_vocab(with_added_tokens=False)
        special = set(self.a.get_added_tokens_decoder())
        ranks = {bytes(of[c] for c in piece): i for piece, i in vocab.items() if i not in special}
        self.fast = tiktoken.Encoding("bytes", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})  # ids rise with the merges
        self.a_size = np.zeros(max(vocab.values()) + 1, np.int64)
        self.a_size[list(ranks.values())] = [len(r) for r in ranks]
        names = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.b_bytes, self.b_at, self.b_size = _listed([bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("\u2581", " ").encode() for i, p in enumerate(names)])
        self.digits, self.digits_at, self.digits_size = _listed([f"{i} ".encode() for i in range(max(len(names), len(self.a_size)))])

    def _ids_a(self, text: str) -> np.ndarray:
        if SETTLED(text):
            return self.fast.encode_to_numpy(text, allowed_special=set(), disallowed_special=()).astype(np.int64)
        return np.array(self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int64)

    def align(self, texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
        """Of texts that begin with a space: counts of tokens of A and B, groups, overlaps and links; the groups as text; the links
        as codes a << 32 | b, one text after the other. A text that the tokens don't give back has -1 for its counts."""
        n = len(texts)
        if not n:
            return np.zeros((0, 5), np.int64), [], np.zeros(0, np.int64), np.zeros(0, np.int64)
        raw = [t.encode() for t in texts]
        sizes = np.array([len(r) for r in raw])
        of_a, of_b = [self._ids_a(t) for t in texts], [np.array(self.b.encode(t[1:], num_threads=1), np.int64) for t in texts]
        good = np.zeros(n, bool)
        for i, (r, x, y) in enumerate(zip(raw, of_a, of_b, strict=True)):
            good[i] = self.a_size[x].sum() == sizes[i] == self.b_size[y].sum() and _taken(self.b_bytes, self.b_at[y], self.b_size[y]).tobytes() == r
        kept_ = np.flatnonzero(good)
        none = [np.zeros(0, np.int64)]
        a, b = (np.concatenate([*(side[i] for i in kept_.tolist()), *none]) for side in (of_a, of_b))
        which = np.repeat(kept_, [len(of_a[i]) for i in kept_.tolist()])  # text of each token of A
        # the owners of each byte
        own_a, own_b = np.repeat(np.arange(len(a), dtype=np.int32), self.a_size[a]), np.repeat(np.arange(len(b), dtype=np.int32), self.b_size[b])
        new_a, new_b = (np.diff(own, prepend=-1) != 0 for own in (own_a, own_b))
        cuts = new_a & new_b
        group = np.cumsum(cuts, dtype=np.int32) - 1
        ga, gb = group[new_a], group[new_b]
        groups = int(cuts.sum())
        in_a, in_b = np.bincount(ga, minlength=groups), np.bincount(gb, minlength=groups)
        last_a, last_b = np.cumsum(in_a), np.cumsum(in_b)
        text_of = which[last_a - 1]  # of each group
        per = lambda w: np.bincount(text_of, weights=w, minlength=n).astype(np.int64)
        overlaps = np.bincount(which[own_a[new_a | new_b]], minlength=n)
        counts = np.stack([per(in_a), per(in_b), np.bincount(text_of, minlength=n), overlaps, per(in_a * in_b)], axis=1)
        counts[~good] = -1
        # all pairs of a group: each token of A meets the group's tokens of B
        meets = in_b[ga]
        codes = np.repeat(a << 32, meets) | _taken(b, (last_b - in_b)[ga], meets)
        # the groups' tokens in turn, as digits and a mark
        ids, mark = np.empty(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
        ids[np.arange(len(a)) + (last_b - in_b)[ga]], ids[np.arange(len(b)) + last_a[gb]] = a, b
        mark[last_a - 1 + last_b - in_b], mark[last_a + last_b - 1] = ord("|"), ord(";")
        spelled = _taken(self.digits, self.digits_at[ids], self.digits_size[ids])
        ends = np.cumsum(self.digits_size[ids])
        spelled[ends - 1] = mark
        stops = np.concatenate([[0], ends])[np.cumsum(np.where(good, counts[:, 0] + counts[:, 1], 0))].tolist()
        out = spelled.tobytes().decode()
        return counts, [out[s : e - 1] for s, e in zip([0, *stops], stops, strict=False)], codes, np.where(good, counts[:, 4], 0)

    def block(self, texts: list[str | None]):
        """Of some documents: counts, groups as text (null without tokens), the distinct pairs as codes, each document's links as
        numbers of these with their times, and how many documents hold each pair."""
        parts = [pieces(" " + t) if t else [] for t in texts]
        flat = [p for ps in parts for p in ps]
        doc = np.repeat(np.arange(len(texts)), [len(ps) for ps in parts])
        counts, spelled, codes, links, start = [np.zeros((0, 5), np.int64)], [], [], [], 0
        for end in _ends([len(p) for p in flat], BLOCK):
            c, s, x, m = self.align(flat[start:end])
            counts.append(c)
            spelled += s
            codes.append(x)
            links.append(m)
            start = end
        counts, links = np.concatenate(counts), np.concatenate([*links, np.zeros(0, np.int64)])
        good = np.bincount(doc, weights=counts[:, 0] < 0, minlength=len(texts)) == 0
        sums = np.zeros((len(texts), 5), np.int64)
        np.add.at(sums, doc, counts)
        sums[~good] = 0
        first = np.searchsorted(doc, np.arange(len(texts) + 1))
        groups = [";".join(spelled[first[i] : first[i + 1]]) if good[i] and parts[i] else None for i in range(len(texts))]
        who = np.repeat(doc, links)
        keep = good[who]
        codes, local = np.unique(np.concatenate([*codes, np.zeros(0, np.int64)])[keep], return_inverse=True)
        key, times = np.unique(who[keep] * max(1, len(codes)) + local, return_counts=True)
        who, pair = np.divmod(key, max(1, len(codes)))
        edges = np.searchsorted(who, np.arange(1, len(texts)))
        return sums, groups, codes, np.split(pair.astype(np.int32), edges), np.split(times.astype(np.int32), edges), np.bincount(pair, minlength=len(codes))


def _ends(sizes: list[int], most: int):
    """Where to end stretches of about `most` in sum."""
    total = 0
    for i, n in enumerate(sizes, 1):
        total += n
        if total >= most or i == len(sizes):
            yield i
            total = 0


def align_tokens(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """One row for each row of docs: doc_id, counts of tokens, groups, overlaps (pairs of tokens that share bytes) and links
    (pairs that share a group), and groups as text: `a1,a2|b1;a3|b2,b3`, ids of A and of B between two cuts.

    A encodes a space and the text by a byte-level `tokenizers` file, B the text by a SentencePiece model that adds the space;
    special tokens' strings are plain text. Null and empty texts, and those that the tokens of one side don't give back, have no
    tokens: zeros and no text. The other columns are for linked(): the block, the distinct links of the document as numbers of the
    block's pairs with their times, and, in the block's last row, these pairs with the number of the block's documents that hold
    them. A block has about `block` bytes, or one longer text; rows that repeat stay apart.
    """
    slim = docs.select(F.spark_partition_id().alias("part"), F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    names = ["block", "doc_id", "n_a", "n_b", "n_groups", "n_overlaps", "n_links", "groups", "pair", "times", "pairs"]
    pair_type = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("docs", pa.int32())]))

    def run(batches):
        aligner, number = kept(("aligner", a_path, b_path), lambda: Aligner(a_path, b_path)), 0
        for batch in batches:
            part, ids, column = batch.column("part"), batch.column("doc_id"), batch.column("text")
            sizes, start = pc.binary_length(column).fill_null(0).to_pylist(), 0
            for end in _ends(sizes, block):
                counts, groups, codes, pair, times, holders = aligner.block(column.slice(start, end - start).to_pylist())
                dictionary = pa.StructArray.from_arrays([pa.array(x.astype(np.int32)) for x in (codes >> 32, codes & 0xFFFFFFFF, holders)], fields=list(pair_type.value_type))
                listed = pa.ListArray.from_arrays(pa.array([None] * (end - start - 1) + [0, len(codes)], pa.int32()), dictionary, type=pair_type)
                block_id = pa.array(np.full(end - start, (part[start].as_py() << 32) + number))
                cols = [block_id, ids.slice(start, end - start), *(pa.array(counts[:, i]) for i in range(5)), pa.array(groups, pa.string()), pa.array(pair, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int32())), listed]
                yield pa.RecordBatch.from_arrays(cols, names)
                number, start = number + 1, end

    return slim.mapInArrow(run, f"{DOC.format(id=slim.schema['doc_id'].dataType.simpleString())}, {LINKS}")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(a, b, count, best): how many documents hold a and b linked, and whether no other id of B is linked with a in more."""
    pairs = aligned.where("pairs is not null").select(F.explode("pairs").alias("p")).select("p.*")
    counts = pairs.groupBy("a", "b").agg(F.sum("docs").alias("count"))
    most = counts.groupBy("a").agg(F.max("count").alias("most"))
    return counts.join(most, "a").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best"))


def linked(aligned: DataFrame) -> DataFrame:
    """The rows of align_tokens(), other columns chosen by the caller, with n_best (links whose count is the highest of their
    id of A, ties included) and count_sum (of the links' counts) in place of the columns on links.

    Counts meet the documents block by block: each block's pairs are joined with the counts, and the block's rows read them from
    there, so that what is joined grows with the blocks' distinct pairs and not with the links.
    """
    keep = [c for c in aligned.columns if c not in ("pair", "times", "pairs")]
    rows = cut(aligned, "aligned")
    pairs = rows.where("pairs is not null").select("block", F.posexplode("pairs").alias("at", "p")).select("block", "at", "p.a", "p.b")
    known = pairs.join(pair_counts(rows), ["a", "b"]).select(F.col("block").alias("of"), "at", "count", "best")
    slim = rows.drop("pairs")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        at = right.column("at").to_numpy()
        count, best = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        count[at], best[at] = right.column("count").to_numpy(), right.column("best").to_numpy(zero_copy_only=False)
        pair, times = left.column("pair").combine_chunks(), left.column("times").combine_chunks()
        of, times = pair.flatten().to_numpy(), times.flatten().to_numpy()
        row = np.repeat(np.arange(len(left)), pair.value_lengths().to_numpy(zero_copy_only=False))
        sums = [np.zeros(len(left), np.int64) for _ in range(2)]
        for s, values in zip(sums, (best, count), strict=True):
            np.add.at(s, row, times * values[of])
        return left.select(keep).append_column("n_best", pa.array(sums[0])).append_column("count_sum", pa.array(sums[1]))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema if f.name in keep)
    return slim.groupBy("block").cogroup(known.groupBy("of")).applyInArrow(run, f"{kinds}, n_best long, count_sum long")
