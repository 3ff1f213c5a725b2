"""Operator 8, SentencePiece encoding and decoding: Aho-Corasick over pieces drives one Viterbi pass.

The automaton holds every ordinary piece.  Reading a text once, its output links give at each position
all pieces that end there, longest first; each relaxes the best score at that position.  Backward links
give the best segmentation.  Characters that no piece covers become byte pieces.

The scores are those of the model file, so the result is the segmentation of highest total score: what
the public library's lattice finds for the same pieces as a unigram model, with exact sums.  Ties go to
the longer last piece.

Where no piece holds a space mark after another character (true of the given vocabulary, and tested when
it is loaded), the text falls into independent chunks at space marks; each worker keeps the segmentation
of frequent chunks in a cache of bounded size.  Row-local; nothing is shuffled; the vocabulary, a
parameter, is broadcast after its size is checked.

Defined cases: null and empty text have no ids and decode to empty text.  Spaces are written as U+2581,
so a literal U+2581 decodes to a space.  Repeated rows are encoded alike; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import as_bytes, narrow, tidy

SPACE_MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


@dataclass(frozen=True)
class Vocabulary:
    """Pieces in id order with score and kind; options of the normaliser that change the text."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    kinds: tuple[int, ...]
    dummy_prefix: bool = True

    @classmethod
    def load(cls, path: str, most_bytes: int = 64 << 20) -> Vocabulary:
        import os

        import sentencepiece as sp

        if os.path.getsize(path) > most_bytes:
            raise ValueError(f"vocabulary of more than {most_bytes} bytes isn't broadcast: {path}")
        s = sp.SentencePieceProcessor(model_file=path)
        ids = range(s.get_piece_size())
        kind = [BYTE if s.is_byte(i) else CONTROL if s.is_control(i) else UNKNOWN if s.is_unknown(i) else UNUSED if s.is_unused(i) else NORMAL for i in ids]
        prefix = bool(s.encode("a", out_type=str)[0].startswith(SPACE_MARK))
        return cls(tuple(s.id_to_piece(i) for i in ids), tuple(s.get_score(i) for i in ids), tuple(kind), prefix)


class Codec:
    """Encoder and decoder for one vocabulary; the automaton is built in the process that uses it."""

    def __init__(self, vocabulary: Vocabulary, cache: int = 150_000):
        import ahocorasick

        self.vocabulary = vocabulary
        self.limit = cache
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.automaton = ahocorasick.Automaton()
        self.singles: set[str] = set()
        self.byte_ids = [-1] * 256
        self.surface = []
        self.unknown = next((i for i, k in enumerate(vocabulary.kinds) if k == UNKNOWN), 0)
        worst, cut, line = 0.0, True, True
        for i, (p, s, k) in enumerate(zip(vocabulary.pieces, vocabulary.scores, vocabulary.kinds, strict=True)):
            surface = b""
            if k == NORMAL:
                self.automaton.add_word(p, (len(p), float(s), i))
                if len(p) == 1:
                    self.singles.add(p)
                if s > -1e8:
                    worst = min(worst, s)
                cut &= not re.search(f"[^{SPACE_MARK}]{SPACE_MARK}", p)
                line &= "\n" not in p
                surface = p.replace(SPACE_MARK, " ").encode()
            elif k == BYTE:
                self.byte_ids[int(p[1:-1], 16)] = i
                surface = bytes([int(p[1:-1], 16)])
            self.surface.append(surface)
        self.automaton.make_automaton()
        self.unknown_score = worst - 10.0
        # splits at a mark after another character, and round each newline, if no piece spans them
        self.chunk = re.compile((f"{SPACE_MARK}*[^{SPACE_MARK}\n]+|{SPACE_MARK}+|\n" if line else f"{SPACE_MARK}*[^{SPACE_MARK}]+|{SPACE_MARK}+") if cut else r"(?s:.+)")
        if line and cut:
            # marks before a newline are a chunk of their own, and so are marks before the end
            self.chunk = re.compile(f"{SPACE_MARK}+(?=\n|$)|{SPACE_MARK}*[^{SPACE_MARK}\n]+|\n")

    def viterbi(self, text: str) -> list[int]:
        """Ids of the best segmentation of one chunk."""
        n = len(text)
        low = float("-inf")
        best, back = [low] * (n + 1), [(0, -1)] * (n + 1)
        best[0] = 0.0
        covered = self.singles.issuperset(text)
        done = 0
        for end, (size, score, piece) in self.automaton.iter(text):
            end += 1
            if not covered:
                while done < end - 1:
                    done += 1
                    self._unknown(text, done, best, back)
            s = best[end - size] + score
            if s > best[end]:
                best[end], back[end] = s, (end - size, piece)
        if not covered:
            while done < n:
                done += 1
                self._unknown(text, done, best, back)
        out: list[int] = []
        at = n
        while at:
            start, piece = back[at]
            if piece >= 0:
                out.append(piece)
            else:
                raw = text[start:at].encode()
                ids = [self.byte_ids[b] for b in raw]
                out += reversed(ids) if -1 not in ids else [self.unknown]
            at = start
        out.reverse()
        return out

    def _unknown(self, text: str, end: int, best: list[float], back: list[tuple[int, int]]) -> None:
        if text[end - 1] not in self.singles and (s := best[end - 1] + self.unknown_score) > best[end]:
            best[end], back[end] = s, (end - 1, -1)

    def _miss(self, chunk: str) -> bytes:
        found = self.old.get(chunk)
        if found is None:
            found = np.array(self.viterbi(chunk), dtype="<i4").tobytes()
        if len(chunk) <= 64:
            if len(self.young) >= self.limit:
                self.old, self.young = self.young, {}
            self.young[chunk] = found
        return found

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian 32-bit integers."""
        if not text:
            return b""
        text = text.replace(" ", SPACE_MARK)
        if self.vocabulary.dummy_prefix:
            text = SPACE_MARK + text
        get = self.young.get
        return b"".join([get(c) or self._miss(c) for c in self.chunk.findall(text)])

    def decode(self, ids: bytes) -> str:
        raw = b"".join(map(self.surface.__getitem__, np.frombuffer(ids, dtype="<i4").tolist()))
        if self.vocabulary.dummy_prefix and raw.startswith(b" "):
            raw = raw[1:]
        return raw.decode("utf-8", "replace")


_codecs: dict[int, Codec] = {}


def codec(broadcast) -> Codec:
    key = id(broadcast.value)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(broadcast.value)
    return _codecs[key]


def _encode(held, with_ids: bool):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(held)
        for batch in batches:
            n, sha, back, ids = [], [], [], []
            for raw in as_bytes(batch.column("text")):
                text = (raw or b"").decode()
                found = c.encode(text)
                n.append(len(found) // 4)
                sha.append(hashlib.sha256(found).hexdigest())
                back.append(c.decode(found) == text.replace(SPACE_MARK, " "))
                if with_ids:
                    ids.append(np.frombuffer(found, dtype="<i4"))
            out = [batch.column("id"), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.bool_())]
            yield pa.RecordBatch.from_arrays(out + ([pa.array(ids, pa.list_(pa.int32()))] if with_ids else []), names=["id", "n_tokens", "ids_sha256", "round_trip"] + ["ids"] * with_ids)

    return run


def encode(docs: DataFrame, vocabulary: Vocabulary, *, id_column: str = "doc_id", text_column: str = "text", with_ids: bool = True) -> DataFrame:
    """One row a document: id, n_tokens, ids_sha256 (of 32-bit little-endian ids), round_trip, ids."""
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)
    kinds = "id long, n_tokens long, ids_sha256 string, round_trip boolean" + ", ids array<int>" * with_ids
    return narrow(docs, id=id_column, text=text_column).mapInArrow(_encode(held, with_ids), kinds)


def decode(rows: DataFrame, vocabulary: Vocabulary, *, id_column: str = "id", ids_column: str = "ids") -> DataFrame:
    """id, text of arrays of ids; null decodes to empty text."""
    held = rows.sparkSession.sparkContext.broadcast(vocabulary)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(held)
        for batch in batches:
            text = [c.decode(np.array(x or [], dtype="<i4").tobytes()) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(text, pa.string())], names=["id", "text"])

    out = T.StructType([T.StructField("id", T.LongType()), T.StructField("text", T.StringType())])
    return narrow(rows, id=id_column, ids=ids_column).mapInArrow(run, out)


def given_vocabulary() -> Vocabulary:
    """The public 32,000-piece vocabulary of this machine; another path is a parameter of Vocabulary.load."""
    import public_tokenizers

    return Vocabulary.load(public_tokenizers.path("piece_bpe_32k.model"))
