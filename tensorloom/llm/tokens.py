"""Token ids of whole texts by a `tokenizers` file, encoding each distinct stretch between white space once."""

from __future__ import annotations

import ctypes
import gc
import json
import sys
import time
import types

import numpy as np
import pyarrow as pa
import regex

#: Printable ASCII without "<", and Latin letters of the supplement that are their own NFC form.
LATIN = regex.compile(r"[!-;=-~\u00c0-\u00ff]*").fullmatch
#: str.split() also parts at these, which the tokenizer's white space (White_Space of Unicode) leaves out.
SEPARATORS = "\x1c\x1d\x1e\x1f"
STRETCHES = regex.compile(r"[^\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+").findall


def kept(key: tuple, make):
    """An object that a worker process keeps for its later tasks; functions sent to a worker have no state of their own.
    One object is kept at a time, so that memory stays bounded."""
    state = sys.modules.setdefault("tensorloom_worker_state", types.ModuleType("tensorloom_worker_state")).__dict__
    if key not in state:
        release()
        state[key] = make()
    return state[key]


def release() -> None:
    """Drop what kept() holds in this process and give free memory back to the system."""
    state = sys.modules.get("tensorloom_worker_state")
    old = [k for k in state.__dict__ if isinstance(k, tuple)] if state else []
    for k in old:
        del state.__dict__[k]
    if old:
        gc.collect()
        trim()


def trim() -> None:
    """Give this process's free memory, Arrow's and the C library's, back to the system."""
    pa.default_memory_pool().release_unused()
    give = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give:
        give(0)


def lean(run):
    """run, a function for mapInArrow, in a worker that waits for its next task without what this one left behind.

    Functions that are sent to a worker refer to themselves, so only a collection, at most one in five seconds, frees the
    tables of earlier tasks."""

    def done(batches):
        release()
        state = sys.modules.setdefault("tensorloom_worker_state", types.ModuleType("tensorloom_worker_state")).__dict__
        if time.monotonic() - state.get("collected", 0) > 5:
            gc.collect()
            state["collected"] = time.monotonic()
        try:
            yield from run(batches)
        finally:
            trim()

    return done


class _Places(dict):
    """The number of each chunk; new chunks get the next one and are listed."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, chunk: str) -> int:
        n = self[chunk] = len(self)
        self.new.append(chunk)
        return n


class ChunkEncoder:
    """Ids of texts by a tokenizer that lower-cases and whose normaliser and splitter never look across white space.

    A text's ids are then those of its stretches between white space, one after the other. Up to about `most` stretches
    and `most_chars` characters of them are remembered, and what one batch adds. Stretches to learn are encoded together, with a special token between them, which no merge crosses.
    """

    def __init__(self, path: str, most: int = 250_000, most_chars: int = 8_000_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.most, self.most_chars = Tokenizer.from_file(path), most, most_chars
        special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.mark, self.mark_id = next(iter(special.items()))
        self.special = list(special)
        self.fast = self._fast()
        self._clear()

    def _clear(self):
        self.place, self.chars = _Places(), 0
        self.flat, self.begin, self.size = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)

    def _split(self, text: str) -> list[str]:
        # upper-case forms of special tokens are ordinary text
        if "<" not in text:
            text = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
        return STRETCHES(text) if any(c in text for c in SEPARATORS) else text.split()

    def _fast(self):
        """The same merges as a rank table, for chunks of Latin letters, or None if the file has another form.

        In a byte-level BPE with word ends, ids rise with the merges' order: single bytes, bytes at a word's end, merges.
        A zero byte stands for the word's end; chunks with a zero byte don't come here.
        """
        import tiktoken

        spec = json.loads(self.tokenizer.to_str())
        model, normal, split = spec["model"], spec["normalizer"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or model.get("end_of_word_suffix") != "</w>" or [n["type"] for n in normal["normalizers"]] != ["NFC", "Replace", "Lowercase"] or split["pretokenizers"][0]["behavior"] != "Removed":
            return None
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # bytes that stand for themselves
        of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        ranks = {}
        for piece, i in model["vocab"].items():
            end = piece.endswith("</w>") and len(piece) > 4
            ranks[bytes(of[c] for c in (piece[:-4] if end else piece)) + b"\0" * end] = i
        self.ends = np.zeros(max(model["vocab"].values()) + 1, bool)
        self.ends[[i for piece, i in model["vocab"].items() if piece.endswith("</w>") and len(piece) > 4]] = True
        self.splitter = regex.compile(split["pretokenizers"][0]["pattern"]["Regex"])
        return tiktoken.Encoding("words", pat_str="[^\\x00]+\\x00", mergeable_ranks=ranks, special_tokens={})

    def _learn(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one chunk after the other, and how many each has."""
        easy = [i for i, c in enumerate(chunks) if LATIN(c)] if self.fast else []
        if not easy:
            return self._learn_slowly(chunks)
        words = [self.splitter.findall(chunks[i].lower()) for i in easy]
        ids = np.array(self.fast.encode_ordinary("".join([w + "\0" for ws in words for w in ws])), np.uint32)
        # each word has one piece with a word end, its last
        word_ends = np.flatnonzero(self.ends[ids]) + 1
        words_of = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        bounds = np.concatenate([[0], word_ends])[words_of]
        size = np.zeros(len(chunks), np.int64)
        size[easy] = np.diff(bounds, prepend=0)
        if len(easy) == len(chunks):
            return ids, size
        hard = np.setdiff1d(np.arange(len(chunks)), easy)
        more, n = self._learn_slowly([chunks[i] for i in hard])
        size[hard] = n
        flat, begin = np.empty(int(size.sum()), np.uint32), np.cumsum(size) - size
        for part, at in ((ids, np.array(easy)), (more, hard)):
            flat[np.repeat(begin[at] - (np.cumsum(size[at]) - size[at]), size[at]) + np.arange(len(part))] = part
        return flat, size

    def _learn_slowly(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        odd = {i for i, c in enumerate(chunks) if any(s in c for s in self.special)} if any("<" in c for c in chunks) else set()
        sizes, parts = [], []
        for at in range(0, len(chunks), 2000):
            some = chunks[at : at + 2000]
            joined = self.mark.join("" if at + i in odd else c for i, c in enumerate(some))
            ids = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.uint32)
            marks = np.flatnonzero(ids == self.mark_id)
            n = np.diff(np.concatenate([[-1], marks, [len(ids)]])) - 1
            if any(at + i in odd for i in range(len(some))):
                cut = np.split(np.delete(ids, marks), np.cumsum(n)[:-1])
                cut = [np.array(self.tokenizer.encode(c, add_special_tokens=False).ids, np.uint32) if at + i in odd else cut[i] for i, c in enumerate(some)]
                n, ids = np.array([len(c) for c in cut]), np.concatenate(cut)
            else:
                ids = np.delete(ids, marks)
            sizes.append(n)
            parts.append(ids)
        return np.concatenate(parts), np.concatenate(sizes)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """One array of ids for each text."""
        if len(self.place) > self.most or self.chars > self.most_chars:
            self._clear()
        places = []
        for t in texts:
            chunks = self._split(t)
            places.append(np.fromiter(map(self.place.__getitem__, chunks), np.int64, len(chunks)))
        if self.place.new:
            flat, size = self._learn(self.place.new)
            self.chars += sum(map(len, self.place.new))
            self.place.new = []
            self.begin = np.concatenate([self.begin, len(self.flat) + np.cumsum(size) - size])
            self.flat, self.size = np.concatenate([self.flat, flat]), np.concatenate([self.size, size])
        out = []
        for at in places:
            n = self.size[at]
            ends = np.cumsum(n)
            out.append(self.flat[np.repeat(self.begin[at] - (ends - n), n) + np.arange(ends[-1])] if len(at) else np.empty(0, np.uint32))
        return out


def batches_of(texts: list[str], size: int = 4_000_000):
    """Lists of (row, text) with about `size` characters each, so that the memory of a batch is bounded."""
    now, total = [], 0
    for i, t in enumerate(texts):
        now.append((i, t))
        total += len(t)
        if total >= size:
            yield now
            now, total = [], 0
    if now:
        yield now
