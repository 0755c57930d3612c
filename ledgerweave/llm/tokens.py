"""Exact token ids of many texts: pieces found with arrays, each distinct piece encoded once per worker.

The public vocabularies used here cut a text into runs of letters, digits and other characters before their BPE
model sees it, and a single space between visible characters is always a border. Both facts let a task find the
pieces of a whole batch with array operations, look their ids up in a bounded cache by a 64-bit hash, and ask the
library only about pieces it has not met. A word with characters outside those rules (an apostrophe, a letter
beyond Latin-1, a control) is given to the library as a whole word, and a text with runs of white space or with
white space beyond ASCII as a whole text, so the result always equals the library's own.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from .common import flat, pieces
from .words import span_hashes

#: Slots of each of the two cache tables, and the pieces after which a worker starts its cache anew.
SLOTS = 1 << 21
CACHE_PIECES = 1_000_000

_SPACE, _BREAK, _LETTER, _DIGIT, _OTHER, _ODD = range(6)


def _classes() -> np.ndarray:
    kind = np.full(256, _ODD, np.uint8)
    kind[33:127] = _OTHER
    for low, high in ((65, 91), (97, 123), (0x80, 0xC0)):  # continuation bytes take part in letters
        kind[low:high] = _LETTER
    kind[0xC3] = _LETTER
    kind[48:58] = _DIGIT
    kind[32], kind[10] = _SPACE, _BREAK
    kind[39] = _ODD  # contractions
    return kind


_KIND = _classes()
_ASCII_WHITE = np.zeros(256, bool)
_ASCII_WHITE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
#: What the model may be asked about directly: characters that are not _ODD.
_EASY = re.compile("[\n -&(-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
#: The byte-level alphabet: printable Latin-1 stands for itself, other bytes for characters from 256 on.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE = {b: b for b in _PLAIN} | {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _PLAIN)}


class PieceEncoder:
    """encode(texts) -> (ids, offsets), equal to the library's encoding of every text without special tokens."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.spaced = self.tokenizer.normalizer is None  # a byte-level vocabulary keeps the space before a word
        self.model = self.tokenizer.model
        self._reset()

    def _reset(self) -> None:
        self.keys = np.zeros((2, SLOTS), np.uint64)
        self.numbers = np.zeros((2, SLOTS), np.int32)
        self.ids = np.zeros(1 << 16, np.uint32)
        self.at = np.zeros(1 << 14, np.int64)
        self.n = 0

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _odd_texts(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Numbers of the texts that must be encoded whole."""
        white = _ASCII_WHITE[data]
        cut = np.zeros(len(data) + 1, bool)
        cut[at] = True
        hits = [np.flatnonzero(white[1:] & white[:-1] & ~cut[1:-1])]
        wide = np.flatnonzero((data == 0xC2) | (data == 0xE1) | (data == 0xE2) | (data == 0xE3))
        found = np.unique(np.searchsorted(at, np.concatenate([hits[0], wide]), side="right") - 1)
        if not len(wide):
            return found
        double = set((np.searchsorted(at, hits[0], side="right") - 1).tolist())
        return np.array([i for i in found.tolist() if i in double or any(c.isspace() and c > "\x7f" for c in data[at[i] : at[i + 1]].tobytes().decode())], np.int64)

    def _pieces(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the pieces of texts without white-space runs."""
        kind = _KIND[data]
        lead = data[:-1] == 0xC3
        sign = np.flatnonzero(lead & ((data[1:] == 0x97) | (data[1:] == 0xB7)))  # multiplication and division signs
        kind[sign] = kind[sign + 1] = _ODD
        before = np.empty_like(kind)
        before[0], before[1:] = _BREAK, kind[:-1]
        head = at[:-1][at[:-1] < at[1:]]
        before[head] = _BREAK
        odd = np.flatnonzero(kind == _ODD)
        visible = kind >= _LETTER
        start = kind != before
        if self.spaced:
            start[visible & (before == _SPACE)] = False
            start[head] = True
        else:
            start |= kind == _DIGIT
            start &= visible
        start |= (kind == _BREAK) & self.spaced
        if len(odd):  # whole words instead
            word = np.flatnonzero(~visible | ((before < _LETTER) & visible))  # borders of words
            i = np.unique(np.searchsorted(word, odd, side="right") - 1)
            low = word[i]
            high = np.append(word, len(data))[i + 1]
            delta = np.zeros(len(data) + 1, np.int32)
            delta[low + 1] += 1
            delta[high] -= 1
            start[np.cumsum(delta[:-1]) > 0] = False
            if self.spaced:
                start[low] = ~((low > 0) & (before[low] == _SPACE))
            else:
                start[low] = True
        starts = np.flatnonzero(start)
        if self.spaced:
            return starts, np.append(starts[1:], len(data))
        border = np.flatnonzero(start | ~visible | (before < _LETTER))
        return starts, np.append(border, len(data))[np.searchsorted(border, starts, side="right")]

    def _encode_piece(self, piece: bytes) -> bytes:
        text = piece.decode()
        if not _EASY.fullmatch(text):
            return array("I", self.whole([text])[0]).tobytes()
        if not self.spaced:
            text = text.lower()
        if not text.isascii() or not text.isalnum():
            text = text.encode().decode("latin-1").translate(_BYTE)
        return array("I", [t.id for t in self.model.tokenize(text)]).tobytes()

    def _numbers(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Cache numbers of the pieces; pieces not met before are encoded."""
        if self.n > CACHE_PIECES:
            self._reset()
        key = span_hashes(data, starts, ends, None) | np.uint64(1)
        slot = (key >> np.uint64(1)) & np.uint64(SLOTS - 1), (key >> np.uint64(33)) & np.uint64(SLOTS - 1)
        number = np.where(self.keys[0][slot[0]] == key, self.numbers[0][slot[0]], -1)
        second = self.keys[1][slot[1]] == key
        number[second] = self.numbers[1][slot[1][second]]
        missed = np.flatnonzero(number < 0)
        if len(missed):
            new, first, back = np.unique(key[missed], return_index=True, return_inverse=True)
            raw = data.tobytes()
            at = missed[first]
            got = [self._encode_piece(raw[s:e]) for s, e in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
            size = np.fromiter(map(len, got), np.int64, len(got)) // 4
            used, more = int(self.at[self.n]), self.n + len(got)
            while more + 1 > len(self.at):
                self.at = np.concatenate([self.at, np.zeros_like(self.at)])
            while used + int(size.sum()) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
            self.at[self.n + 1 : more + 1] = used + np.cumsum(size)
            self.ids[used : used + int(size.sum())] = np.frombuffer(b"".join(got), np.uint32)
            fresh = np.arange(self.n, more, dtype=np.int32)
            taken = self.keys[0][slot[0][at]] != 0  # a taken slot of the first table sends a piece to the second
            for k, mine in ((0, ~taken), (1, taken)):
                self.keys[k][slot[k][at[mine]]] = new[mine]
                self.numbers[k][slot[k][at[mine]]] = fresh[mine]
            self.n = more
            number[missed] = fresh[back]
        return number

    def _chunk(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(at) - 1, np.int64)
        starts, ends = self._pieces(data, at)
        number = self._numbers(data, starts, ends)
        low, high = self.at[number], self.at[number + 1]
        size = high - low
        total = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[np.repeat(low - total[:-1], size) + np.arange(total[-1])]
        return ids, np.diff(total[np.searchsorted(starts, at)])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, at = flat(texts)
        parts: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        for i, j in pieces(at):
            part, here = data[at[i] : at[j]], at[i : j + 1] - at[i]
            odd = self._odd_texts(part, here) if len(part) else np.zeros(0, np.int64)
            if not len(odd):
                ids, size = self._chunk(part, here)
                parts.append(ids)
                sizes.append(size)
                continue
            last = 0
            for k in [*odd.tolist(), j - i]:
                ids, size = self._chunk(part[here[last] : here[k]], here[last : k + 1] - here[last])
                parts.append(ids)
                sizes.append(size)
                if k < j - i:
                    whole = self.whole([part[here[k] : here[k + 1]].tobytes().decode()])[0]
                    parts.append(np.array(whole, np.uint32))
                    sizes.append(np.array([len(whole)], np.int64))
                last = k + 1
        return np.concatenate([np.zeros(0, np.uint32), *parts]), np.concatenate([[0], np.cumsum(np.concatenate([np.zeros(0, np.int64), *sizes]))])


@lru_cache(maxsize=2)
def encoder(name_or_path: str) -> PieceEncoder:
    """The encoder of a vocabulary file: a public file's name, or a path. One for each worker process."""
    return PieceEncoder(name_or_path if "/" in name_or_path else public_tokenizers.path(name_or_path))


def encoded(batches: Iterator[pa.RecordBatch], vocabulary: str, end_id: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with the ids (end id appended) and id offsets of their texts."""
    encode = encoder(vocabulary).encode
    for batch in batches:
        _, at = flat(batch.column("text"))
        for i, j in pieces(at):
            part = batch.slice(i, j - i)
            ids, bounds = encode(part.column("text"))
            ends = bounds[1:] + np.arange(1, len(bounds))
            out = np.full(len(ids) + j - i, end_id, np.uint32)
            mine = np.ones(len(out), bool)
            mine[ends - 1] = False
            out[mine] = ids
            yield part, out, np.concatenate([[0], ends])
