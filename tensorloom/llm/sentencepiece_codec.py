"""SentencePiece encoding and decoding by Viterbi, batched over equally long words in numpy.

Words of one length advance together. Substrings are known by polynomial prefix hashes, so all substrings that end at one
place are probed in the sorted piece keys at once, and a vectorised maximum over the starts is kept with a back pointer.

A unigram model takes the sum of scores. A BPE model defines its ids by merges in the order of its ranks, which is not the best
sum. Its segmentations are those in which every two neighbours stay apart when merged alone, and each prefix of a word has
just one; so the path's score is 0, or minus infinity where a piece doesn't stay apart from the one that the path to its
start ends with, and the maximum finds the merges' result. Whether two pieces stay apart follows from the merge trees
along their common border, for all pairs of a batch together. The columns of a long BPE word are made in stretches that
advance together: a stretch depends on what is before it only through as many columns as the longest piece has characters.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tensorloom.llm.sharding import _mix
from tensorloom.llm.tokens import ChunkEncoder, batches_of, kept

SPACE = "▁"
_BASE = np.uint64(0x9E3779B97F4A7C15)
LONG = 256  # longer BPE words are cut into stretches of this length
ROUNDS = 4  # in which all stretches guess at once what comes before them
LONG_CHARS = 1 << 18  # of long words whose stretches advance together; a multiple of LONG
PAIR_BITS = 20  # of the table of piece pairs that a worker remembers
BUCKET_BITS = 18  # of a key, for which the first sorted key is known
BATCH_CELLS = 2_000_000


class Pieces:
    """The vocabulary of a model file: sorted keys of pieces, ids, scores, byte pieces."""

    def __init__(self, path: str | bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        if isinstance(path, bytes):
            model.ParseFromString(path)
        else:
            with open(path, "rb") as f:
                model.ParseFromString(f.read())
        norm = model.normalizer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("only models with identity normalisation are supported")
        self.unigram, self.prefix = model.trainer_spec.model_type == 1, norm.add_dummy_prefix
        self.unk = model.trainer_spec.unk_id
        self.text = [p.piece for p in model.pieces]
        kinds = [p.type for p in model.pieces]
        normal = [i for i, t in enumerate(kinds) if t in (1, 4)]
        self.bytes = np.full(256, self.unk, np.int64)
        for i, t in enumerate(kinds):
            if t == 6:
                self.bytes[int(self.text[i][3:5], 16)] = i
        self.fallback = bool((self.bytes != self.unk).all())
        self.longest = max(len(self.text[i]) for i in normal)
        self.powers = np.full(self.longest + 2, _BASE, np.uint64)
        self.powers[0] = 1
        self.powers = np.cumprod(self.powers, dtype=np.uint64)
        keys = np.array([self._key(self.text[i]) for i in normal], np.uint64)
        order = np.argsort(_mix(keys))
        self.plain, self.ids = keys[order], np.array(normal, np.int64)[order]
        self.keys = _mix(self.plain)  # sorted, and spread evenly
        self.first = np.searchsorted(self.keys, np.arange(1 << BUCKET_BITS, dtype=np.uint64) << np.uint64(64 - BUCKET_BITS))
        self.widest = int(np.diff(np.append(self.first, len(keys))).max())
        self.keys, self.ids = np.append(self.keys, self.keys[: self.widest]), np.append(self.ids, self.ids[: self.widest])
        if len(np.unique(keys)) < len(keys):
            raise ValueError("two pieces share a key")
        self.scores = np.array([p.score for p in model.pieces], np.float32)
        self.lowest = np.float32(min(self.scores[normal]) - 10)  # of a character that no piece holds
        self.rank = {self.text[i]: (float(self.scores[i]), i) for i in normal}
        surface = [b"" if t in (2, 3) else bytes([int(p[3:5], 16)]) if t == 6 else p.encode() for p, t in zip(self.text, kinds, strict=True)]
        if self.unk >= 0:
            surface[self.unk] = b" \xe2\x81\x87 "
        self.surface_len = np.array([len(s) for s in surface])
        self.surface_at = np.concatenate([[0], np.cumsum(self.surface_len)])
        self.surface = np.frombuffer(b"".join(surface), np.uint8)
        if not self.unigram:
            self._trees(normal)
        self.newline_alone = not any("\n" in self.text[i] and len(self.text[i]) > 1 for i in normal)

    def _key(self, s: str) -> int:
        return int(self.prefix_hashes(np.frombuffer(s.encode("utf-32-le"), np.uint32)[None, :])[0, -1])

    @staticmethod
    def prefix_hashes(codes: np.ndarray) -> np.ndarray:
        h = np.zeros((codes.shape[0], codes.shape[1] + 1), np.uint64)
        for j in range(codes.shape[1]):
            h[:, j + 1] = h[:, j] * _BASE + codes[:, j] + np.uint64(1)
        return h

    def probe(self, keys: np.ndarray) -> np.ndarray:
        """Ids of substrings by key; -1 where no piece has it. The sorted keys are entered at the first one of a key's bucket."""
        mixed = _mix(keys.ravel())
        at = self.first[(mixed >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)]
        out = np.where(self.keys[at] == mixed, self.ids[at], -1)
        for i in range(1, self.widest):
            hit = np.flatnonzero(self.keys[at + i] == mixed)
            out[hit] = self.ids[at[hit] + i]
        return out.reshape(keys.shape)

    def _spell(self, char: str) -> list[int]:
        found = self.rank.get(char)
        if found:
            return [found[1]]
        return self.bytes[list(char.encode())].tolist() if self.fallback else [self.unk]

    def _trees(self, normal: list[int]) -> None:
        """For each piece its hash, length, rank and the two pieces that its last merge joins (-1 for single characters)."""
        n = len(self.text)
        self.own_key, self.size = np.zeros(n, np.uint64), np.array([len(t) for t in self.text], np.int64)
        self.own_key[self.ids[: len(self.plain)]] = self.plain
        self.order = np.full(n, -1, np.int64)  # by falling score, equal ones together; single characters come before all merges
        several = np.array([i for i in normal if len(self.text[i]) > 1], np.int64)
        self.order[several] = np.unique(-self.scores[several], return_inverse=True)[1]
        self.left, self.right = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        for size in np.unique(self.size[several]).tolist():
            at = several[self.size[several] == size]
            for i, ids in zip(at.tolist(), self.merges([self.text[j] for j in at.tolist()], size - 1), strict=True):
                if len(ids) == 2 and max(self.order[ids]) <= self.order[i]:
                    self.left[i], self.right[i] = ids
        self.made = np.zeros(n, bool)  # pieces that merges can make
        self.made[normal] = True
        self.made[several[self.left[several] < 0]] = False
        self.pairs, self.apart = np.full(1 << PAIR_BITS, -1, np.int64), np.zeros(1 << PAIR_BITS, bool)

    def _stay_apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether pieces a[i], b[i] next to each other are what their text is merged to.

        Seen backwards, the later one of the two pieces at the border is undone step by step. A piece over the border would
        have been made if its rank comes before those of the pieces that these two became; among equal ranks the left goes
        first.
        """
        out, end = np.ones(len(a), bool), np.int64(2**62)
        at, x, y = np.arange(len(a)), a.copy(), b.copy()
        x_into, y_into = np.full(len(a), end), np.full(len(a), end)
        while len(at):
            ids = self.probe(self.own_key[x] * self.powers[np.minimum(self.size[y], self.longest)] + self.own_key[y])
            rank = np.where((ids >= 0) & (self.size[x] + self.size[y] <= self.longest), self.order[ids], end)
            joined = (rank < x_into) & (rank <= y_into)
            out[at[joined]] = False
            x_later = self.order[x] > self.order[y]
            x_into, y_into = np.where(x_later, self.order[x], x_into), np.where(x_later, y_into, self.order[y])
            x, y = np.where(x_later, self.right[x], x), np.where(x_later, y, self.left[y])
            more = ~joined & (x >= 0) & (y >= 0)
            at, x, y, x_into, y_into = at[more], x[more], y[more], x_into[more], y_into[more]
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """_stay_apart, remembered in a table of fixed size, where a pair may take another's place; -1 stands for a character
        that no piece has."""
        key = a * len(self.text) + b
        slot = (_mix(key.view(np.uint64)) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)
        out, strange = self.apart[slot], (a < 0) | (b < 0)
        rest = np.flatnonzero((self.pairs[slot] != key) & ~strange)
        if len(rest):
            new, where, place = np.unique(key[rest], return_index=True, return_inverse=True)
            apart = self._stay_apart(new // len(self.text), new % len(self.text))
            out[rest] = apart[place]
            slots, last = np.unique(slot[rest[where]], return_index=True)
            self.pairs[slots], self.apart[slots] = new[last], apart[last]
        return out | strange

    def viterbi(self, words: list[str]) -> list[list[int]]:
        """The segmentations of equally long words."""
        flat, sizes = self.paths(words)
        return [x.tolist() for x in np.split(flat, np.cumsum(sizes)[:-1])]

    def paths(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of equally long words, one word after the other, and how many each has."""
        n, length = len(words), len(words[0])
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(n, length)
        best = np.full((n, length + 1), -np.inf, np.float32)
        best[:, 0] = 0
        piece, rows = np.full((n, length + 1), -1, np.int64), np.arange(n)
        back = self._advance(codes, best, piece, 1)
        # all paths are followed back together
        steps, end = [], np.full(n, length)
        while end.any():
            steps.append(np.where(end > 0, piece[rows, end], -2))
            end = back[rows, end]
        ids = np.stack(steps[::-1], axis=1)
        if not (ids == -1).any():
            return ids[ids >= 0], (ids >= 0).sum(axis=1)
        return self._spelled(words, back, piece)

    def _advance(self, codes: np.ndarray, best: np.ndarray, piece: np.ndarray, first: int) -> np.ndarray:
        """Fills the columns of best and piece from `first` on, given those before it; returns the back pointers."""
        h, rows = self.prefix_hashes(codes), np.arange(len(codes))
        back = np.zeros(piece.shape, np.int64)
        for end in range(first, piece.shape[1]):
            starts = np.arange(max(0, end - self.longest), end)
            ids = self.probe(h[:, end : end + 1] - h[:, starts] * self.powers[end - starts])
            if self.unigram:
                score = np.where(ids >= 0, self.scores[ids], np.float32(-np.inf))
                score[:, -1] = np.where(ids[:, -1] >= 0, score[:, -1], self.lowest)
            else:
                fits = (ids >= 0) & self.made[ids]
                fits[:, -1] = True
                fits &= best[:, starts] > -np.inf
                row, col = np.nonzero(fits)
                fits[row, col] = self.compatible(piece[row, starts[col]], ids[row, col])
                score = np.where(fits, np.float32(0), np.float32(-np.inf))
            total = best[:, starts] + score
            top = total.argmax(axis=1)
            best[:, end], back[:, end], piece[:, end] = total[rows, top], starts[top], ids[rows, top]
        return back

    def long_paths(self, words: list[str]) -> list[list[int]]:
        """The segmentations of BPE words of any length.

        Each word's columns are made in stretches of LONG. All stretches advance together, first as if a word began at each,
        then from what the stretch before ended with, a few rounds long. At last each word is walked from its start, where a
        stretch whose beginning was guessed right is known and any other is made then; so guesses cost time only.
        """
        reach = self.longest
        fresh = np.full((2, reach + 1), -1, np.float64)  # best and piece of the columns before a stretch: a word begins here
        fresh[0] = -np.inf
        fresh[0, reach] = 0
        begin = fresh.tobytes()
        known: dict[tuple, tuple[np.ndarray, bytes]] = {}

        def learn(wanted):
            by: dict[int, list[tuple]] = {}
            for key in wanted:
                if key not in known:
                    known[key] = ()
                    by.setdefault(len(key[0][1]), []).append(key)
            for length, keys in by.items():
                step = max(1, BATCH_CELLS // ((length + reach) * 16))
                for i in range(0, len(keys), step):
                    some = keys[i : i + step]
                    codes = np.frombuffer("".join(x + y for (x, y), _ in some).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(some), -1)
                    before = np.frombuffer(b"".join(seed for _, seed in some), np.float64).reshape(len(some), 2, reach + 1)
                    best, piece = np.full((len(some), reach + length + 1), -np.inf, np.float32), np.full((len(some), reach + length + 1), -1, np.int64)
                    best[:, : reach + 1], piece[:, : reach + 1] = before[:, 0], before[:, 1]
                    self._advance(codes, best, piece, reach + 1)
                    ends = np.stack([best[:, -reach - 1 :], piece[:, -reach - 1 :]], axis=1).astype(np.float64)
                    for key, own, end in zip(some, piece[:, reach + 1 :].astype(np.int32), ends, strict=True):
                        known[key] = own, end.tobytes()

        seen, columns = [begin] * len(words), [[] for _ in words]
        for at in range(0, max(map(len, words)), LONG_CHARS):
            known.clear()
            # a stretch's text includes the characters before it that its pieces may hold
            cuts = [[(w[max(0, i - reach) : i].rjust(reach, "\0"), w[i : i + LONG]) for i in range(at, min(at + LONG_CHARS, len(w)), LONG)] for w in words]
            seeds = [[s, *[begin] * (len(c) - 1)] for s, c in zip(seen, cuts, strict=True)]
            for _ in range(ROUNDS):
                learn((x, s) for c, own in zip(cuts, seeds, strict=True) for x, s in zip(c, own, strict=False))
                after = [[s, *(known[x, y][1] for x, y in zip(c[:-1], own, strict=False))] for s, c, own in zip(seen, cuts, seeds, strict=True)]
                if after == seeds:
                    break
                seeds = after
            for i, c in enumerate(cuts):
                for x in c:
                    learn([(x, seen[i])])
                    own, seen[i] = known[x, seen[i]]
                    columns[i].append(own)
        out = []
        for word, own in zip(words, columns, strict=True):
            ids, path, end = np.concatenate(own), [], len(word)
            while end:
                i = int(ids[end - 1])
                path.extend([i] if i >= 0 else reversed(self._spell(word[end - 1])))
                end -= int(self.size[i]) if i >= 0 else 1
            out.append(path[::-1])
        return out

    def _spelled(self, words: list[str], back: np.ndarray, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where a character is in no piece, paths are spelled one by one."""
        out = []
        for word, to, ids in zip(words, back.tolist(), piece.tolist(), strict=True):
            path, end = [], len(word)
            while end:
                if ids[end] >= 0:
                    path.append(ids[end])
                else:
                    path.extend(reversed(self._spell(word[end - 1])))
                end = to[end]
            out.append(path[::-1])
        return np.array([x for path in out for x in path], np.int64), np.array([len(path) for path in out])

    def merges(self, words: list[str], longest: int | None = None) -> list[list[int]]:
        """BPE of equally long words by the definition, for the merge trees of pieces and for tests: each round joins the best
        pair of each word, the first among equals, to pieces of up to `longest` characters."""
        n, length, longest = len(words), len(words[0]), longest or self.longest
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(n, length)
        h = self.prefix_hashes(codes)
        border = np.ones((n, length + 1), bool)
        live = np.arange(n)
        place = np.arange(length + 1)
        while length > 1 and len(live):
            b = border[live]
            before = np.maximum.accumulate(np.where(b, place, 0), axis=1)[:, :-2]  # the border at or before j - 1
            after = np.minimum.accumulate(np.where(b, place, length)[:, ::-1], axis=1)[:, ::-1][:, 2:]
            inner = b[:, 1:-1] & (after - before <= longest)
            row, col = np.nonzero(inner)
            s, e = before[row, col], after[row, col]
            ids = self.probe(h[live[row], e] - h[live[row], s] * self.powers[e - s])
            score = np.full(inner.shape, -np.inf, np.float32)
            score[row, col] = np.where(ids >= 0, self.scores[ids], -np.inf)
            top = score.argmax(axis=1)
            good = score[np.arange(len(live)), top] > -np.inf
            live = live[good]
            border[live, top[good] + 1] = False
        out = []
        for i, word in enumerate(words):
            cuts = np.flatnonzero(border[i]).tolist()
            out.append([x for s, e in zip(cuts, cuts[1:], strict=False) for x in ([self.rank[word[s:e]][1]] if e - s > 1 else self._spell(word[s:e]))])
        return out


class SentencePieceEncoder(ChunkEncoder):
    """Ids of texts; each distinct word is encoded once."""

    def __init__(self, path: str | bytes, most: int = 250_000, most_chars: int = 8_000_000):
        self.pieces, self.most, self.most_chars = Pieces(path), most, most_chars
        ends = "\n" if self.pieces.newline_alone else ""
        self.words = re.compile(f"{SPACE}*[^{SPACE}{ends}]+|{SPACE}+" + ("|\n" if ends else ""))
        self._clear()

    def _split(self, text: str) -> list[str]:
        if not text:
            return []
        return self.words.findall((SPACE if self.pieces.prefix else "") + text.replace(" ", SPACE))

    def _learn(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        by: dict[int, list[int]] = {}
        for i, c in enumerate(chunks):
            by.setdefault(len(c), []).append(i)
        size, parts = np.zeros(len(chunks), np.int64), []
        for length, at in by.items():
            long = length > LONG and not self.pieces.unigram
            step = max(1, LONG_CHARS // length if long else BATCH_CELLS // (length * 16))
            for i in range(0, len(at), step):
                own = np.array(at[i : i + step])
                some = [chunks[j] for j in own.tolist()]
                if long:
                    found = self.pieces.long_paths(some)
                    ids, n = np.array([x for f in found for x in f], np.int64), np.array([len(f) for f in found])
                else:
                    ids, n = self.pieces.paths(some)
                size[own] = n
                parts.append((own, ids, n))
        flat, begin = np.empty(int(size.sum()), np.uint32), np.cumsum(size) - size
        for own, ids, n in parts:
            flat[np.repeat(begin[own] - (np.cumsum(n) - n), n) + np.arange(len(ids))] = ids
        return flat, size

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: pieces one after the other, white space restored, without the space put before a text."""
        p = self.pieces
        n = p.surface_len[ids]
        ends = np.cumsum(n)
        raw = p.surface[np.repeat(p.surface_at[ids] - (ends - n), n) + np.arange(ends[-1])].tobytes() if len(ids) else b""
        text = raw.decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if p.prefix and text.startswith(" ") else text


def sentencepiece_encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) for each row of docs: ids of the whole text without control ids. Null text: null; empty text: no ids."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        encoder = kept(("pieces", model_path), lambda: SentencePieceEncoder(model_path))
        for batch in batches:
            who, texts = batch.column("doc_id"), batch.column("text").to_pylist()
            done = 0
            for some in batches_of([t or "" for t in texts], 2_000_000):
                found = [ids.astype(np.int32) for ids in encoder.encode([t for _, t in some])]
                null = [texts[i] is None for i, _ in some]
                rows = pa.array([None if x else ids for ids, x in zip(found, null, strict=True)], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([who.slice(done, len(some)), rows], ["doc_id", "ids"])
                done += len(some)

    return slim.mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def sentencepiece_decode(encoded: DataFrame, model_path: str, keep: list[str] | None = None) -> DataFrame:
    """(doc_id, text) and the columns to keep for each row of (doc_id, ids, ...). Null ids: null text."""
    keep = ["doc_id", *(keep or [])]
    slim = encoded.select(*keep, "ids")

    def run(batches):
        encoder = kept(("pieces", model_path), lambda: SentencePieceEncoder(model_path))
        for batch in batches:
            rows = batch.column("ids")
            texts = [None if not r.is_valid else encoder.decode(r.values.to_numpy(zero_copy_only=False).astype(np.int64)) for r in rows]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(texts, pa.string())], [*keep, "text"])

    return slim.mapInArrow(run, T.StructType([*slim.select(*keep).schema.fields, T.StructField("text", T.StringType())]))
