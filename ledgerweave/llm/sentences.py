"""SentencePiece encoding and decoding for merge-type vocabularies, checked against the library in each Arrow batch.

The library maps a text's characters (its normaliser alone). What it gives is cut wherever two neighbouring characters
stand together in no piece of the vocabulary: no merge ever crosses such a place, so each segment can be encoded by
itself, and once for each worker. A segment's symbols merge by an agenda of adjacent pairs: the pair whose joined piece
has the highest score goes first, the leftmost of equals, and entries of symbols that have changed since are passed
over. A symbol that is no piece becomes its bytes; vocabularies without byte pieces, or with unused pieces, are refused.

Decoding joins the pieces' texts, byte pieces as UTF-8 (a byte that belongs to no character is U+FFFD), and takes away
the space that the normaliser put in front.

Check: segments that a batch brings anew are encoded by the library too, and all ids of a batch are decoded by it; the
job fails on any difference. Texts are encoded whole; null and empty texts have no ids; repeated rows and equal texts
have equal ids. Other columns are not read, whatever their names; an empty table gives no rows. Null ids stay null.
"""

from __future__ import annotations

import heapq
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from . import common
from .common import flat, pieces

#: Segments that a worker remembers, and the characters beyond which one is not remembered; those up to which an agenda is a list.
REMEMBERED, LONG, SHORT = 1 << 20, 64, 24
#: What stands for a space in pieces.
SPACE = "▁"
_LATIN = 0x250  # classes of characters: those below, the space mark, all others
_OTHER = _LATIN + 1
_NEVER = float("inf")


def _classes(text: str) -> np.ndarray:
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.where(code < _LATIN, code, np.where(code == ord(SPACE), _LATIN, _OTHER)).astype(np.uint16)


class MergeVocabulary(dict):
    """Segment -> ids as bytes of int32; a segment that is missing is encoded by its agenda."""

    def __init__(self, path: str):
        super().__init__()
        self.library = sp = SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        if any(sp.is_unused(i) for i in range(n)):
            raise ValueError(f"{path} has unused pieces, which the agenda does not split again")
        self.ids = {sp.id_to_piece(i): i for i in range(n) if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i))}
        self.cost = {piece: -sp.get_score(i) for piece, i in self.ids.items()}
        bytes_ = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(n) if sp.is_byte(i)}
        if len(bytes_) < 256:  # without them the library makes one unknown id of a run of unknown symbols, across segments
            raise ValueError(f"{path} has no byte pieces")
        self.byte_ids = [bytes_[b] for b in range(256)]
        self.surface = [b"" if sp.is_control(i) else bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.decode([i]).encode() if sp.is_unknown(i) else sp.id_to_piece(i).replace(SPACE, " ").encode() for i in range(n)]
        self.size = np.array([len(s) for s in self.surface], np.int64)
        self.is_byte = np.array([sp.is_byte(i) for i in range(n)])
        self.spaced = np.array([sp.id_to_piece(i).startswith(SPACE) for i in range(n)])
        self.silent = np.array([sp.is_control(i) for i in range(n)])
        self.prefixed = sp.normalize("a").startswith(SPACE)
        self.joins = np.zeros((_OTHER + 1, _OTHER + 1), bool)
        self.joins[_OTHER], self.joins[:, _OTHER] = True, True  # not looked at closely
        for piece in self.ids:
            kind = _classes(piece)
            self.joins[kind[:-1], kind[1:]] = True
        self.new: list[str] = []
        # a character that stands beside no other in any piece parts the segments that the library is asked about
        joined = {c for piece in self.ids if len(piece) > 1 for c in piece}
        alone = [c for c in "\n\t\r" + "".join(map(chr, range(1, 127))) if c not in joined and sp.normalize(f"a{c}a").endswith(f"a{c}a")]
        self.border = alone[0] if alone else None

    def agenda(self, segment: str) -> list[int]:
        """Ids of a segment: adjacent pairs are merged in the order of their score, equal ones from the left."""
        symbols = self._by_list(segment) if len(segment) <= SHORT else self._by_heap(segment)
        ids: list[int] = []
        for symbol in symbols:
            if symbol in self.ids:
                ids.append(self.ids[symbol])
            else:
                ids.extend(self.byte_ids[b] for b in symbol.encode())
        return ids

    def _by_list(self, segment: str) -> list[str]:
        """The agenda of a short segment: the pairs' costs (a high score is a low cost) in the order of their places."""
        cost, symbols = self.cost.get, list(segment)
        waiting = [cost(a + b, _NEVER) for a, b in zip(segment, segment[1:], strict=False)]
        while waiting and (least := min(waiting)) is not _NEVER:
            i = waiting.index(least)
            del waiting[i]
            symbols[i : i + 2] = (joined := symbols[i] + symbols[i + 1],)
            if i:
                waiting[i - 1] = cost(symbols[i - 1] + joined, _NEVER)
            if i < len(waiting):
                waiting[i] = cost(joined + symbols[i + 1], _NEVER)
        return symbols

    def _by_heap(self, segment: str) -> list[str]:
        """The agenda of a long segment: a heap of cost, place and joined length; entries of changed symbols are passed over."""
        cost, symbols = self.cost.get, list(segment)
        last = len(symbols) - 1
        after, before = list(range(1, last + 2)), list(range(-1, last))
        waiting = [(found, i, 2) for i in range(last) if (found := cost(symbols[i] + symbols[i + 1])) is not None]
        heapq.heapify(waiting)
        while waiting:
            _, i, size = heapq.heappop(waiting)
            j = after[i]
            if j > last or not symbols[i] or len(symbols[i]) + len(symbols[j]) != size:
                continue  # one of the two has been merged since
            symbols[i] += symbols[j]
            symbols[j] = ""
            after[i] = k = after[j]
            if k <= last:
                before[k] = i
                if (found := cost(pair := symbols[i] + symbols[k])) is not None:
                    heapq.heappush(waiting, (found, i, len(pair)))
            if (h := before[i]) >= 0 and (found := cost(pair := symbols[h] + symbols[i])) is not None:
                heapq.heappush(waiting, (found, h, len(pair)))
        return [s for s in symbols if s]

    def __missing__(self, segment: str) -> bytes:
        out = array("i", self.agenda(segment)).tobytes()
        self.new.append(segment)
        if len(segment) <= LONG:
            self[segment] = out
        return out

    def check_segments(self) -> None:
        """The library's own ids of the segments met since the last call, many at once where the vocabulary has a border."""
        new, self.new = self.new, []
        if not new:
            return
        if self.border:
            text = self.border + self.border.join(new)
            whole = self.library.normalize(text.replace(SPACE, " "))
            if whole.endswith(text):
                between = array("i", self.agenda(self.border)).tobytes()
                start = array("i", self.agenda(whole[: len(whole) - len(text)])).tobytes()
                mine = b"".join([start, *(part for s in new for part in (between, self[s]))])
                self.new = []
                if mine == np.array(self.library.encode(text.replace(SPACE, " ")), np.int32).tobytes():
                    return
        for text in (s.replace(SPACE, " ") for s in new):
            if self.agenda(self.library.normalize(text)) != self.library.encode(text):
                raise ValueError(f"{text!r} has other ids in the library")

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of the texts."""
        if len(self) > REMEMBERED:
            self.clear()
        texts = self.library.normalize(texts)
        ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
        joined = "".join(texts)
        if not joined:
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        kind = _classes(joined)
        cut = np.ones(len(kind) + 1, bool)
        np.logical_not(self.joins[kind[:-1], kind[1:]], out=cut[1:-1])
        cut[ends] = True
        at = np.flatnonzero(cut)
        at_list = at.tolist()
        got = [self[joined[i:j]] for i, j in zip(at_list, at_list[1:], strict=False)]
        total = np.concatenate([[0], np.cumsum(np.fromiter(map(len, got), np.int64, len(got)) // 4)])
        return np.frombuffer(b"".join(got), np.int32), total[np.searchsorted(at, np.concatenate([[0], ends]))]

    def decode(self, ids: np.ndarray, at: np.ndarray) -> list[str]:
        """Texts of the ids."""
        raw = b"".join(map(self.surface.__getitem__, ids.tolist()))
        places = np.concatenate([[0], np.cumsum(self.size[ids])])
        out = []
        for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            k = i
            while k < j and self.silent[ids[k]]:
                k += 1
            low = int(places[k]) + int(self.prefixed and k < j and self.spaced[ids[k]])
            part = raw[low : int(places[j])]
            try:
                out.append(part.decode())
            except UnicodeDecodeError:
                out.append(self._decode_odd(ids[k:j], low - int(places[k])))
        return out

    def _decode_odd(self, ids: np.ndarray, skip: int) -> str:
        """Byte pieces that are no UTF-8: each byte outside a character is U+FFFD."""
        parts, run = [], b""
        for i in [*ids.tolist(), None]:
            if i is not None and self.is_byte[i]:
                run += self.surface[i]
                continue
            while run:
                for n in (1, 2, 3, 4):
                    try:
                        parts.append(run[:n].decode())
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    parts.append("�")
                    n = 1
                run = run[n:]
            if i is not None:
                parts.append(self.surface[i].decode())
        return "".join(parts)[skip:]


@lru_cache(maxsize=2)
def vocabulary(name_or_path: str) -> MergeVocabulary:
    """The vocabulary of a model file: a public file's name, or a path. One for each worker process."""
    return MergeVocabulary(name_or_path if "/" in name_or_path else public_tokenizers.path(name_or_path))


def encoded(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, ids, decoded) of every row."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = vocabulary(model)
        for batch in batches:
            _, at = flat(batch.column("text"))
            for i, j in pieces(at):
                part = batch.slice(i, j - i)
                ids, bounds = mine.encode([t or "" for t in part.column("text").to_pylist()])
                mine.check_segments()
                texts = mine.decode(ids, bounds)
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))
                if mine.library.decode(lists.to_pylist(), num_threads=1) != texts:
                    raise ValueError("the library decodes some ids of this batch otherwise")
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists, pa.array(texts, pa.string())], ["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(encode, "doc_id long, ids array<int>, decoded string")


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document and the text they stand for, as digests."""
    rows = encoded(common.table(spark, sf_dir, "documents"), "piece_bpe_32k.model")
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
