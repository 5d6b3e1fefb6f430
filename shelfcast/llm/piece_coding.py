"""SentencePiece encoding and decoding: an Aho-Corasick automaton drives a one-pass Viterbi.

All pieces go into one automaton.  It is run once over the text; at each position its state
and the output links behind it give every piece that ends there, and each relaxes the best
score of that position.  Characters that no piece covers fall back to byte pieces.  Decoding
lays the pieces' bytes side by side, so it gives back the very text.

Encoding is a map over Arrow batches with the vocabulary (fixed size) broadcast; rows stay
in their partitions.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
# Parts of texts whose encoding a worker remembers; a bound on memory, without effect on results.
REMEMBER = 500_000
#: Characters of the longest part that is remembered, which bounds the memory for them.
SHORT = 64
# A byte piece costs so much more than the worst piece, as the library counts unknown characters.
PENALTY = 10.0
SLICE = 512


@dataclass(frozen=True)
class Vocabulary:
    """Pieces with scores; ``bytes_`` holds the ids of the 256 byte pieces, ``special`` those that match no text."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    bytes_: tuple[int, ...]
    special: frozenset[int]


def load_vocabulary(path: str = VOCABULARY) -> Vocabulary:
    """Read a model file on the driver (a path is a parameter; the file is never copied).

    A model of merges scores its pieces by rank (-1, -2, ...), which are no log
    probabilities: their sum would favour many small pieces.  Such ranks are turned into
    log probabilities by Zipf's law, -log(rank + 2); other scores are taken as they are.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    size = sp.get_piece_size()
    bytes_ = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(size) if sp.is_byte(i)}
    if len(bytes_) != 256:
        raise ValueError("the vocabulary needs all byte pieces, or texts could not be given back")
    special = frozenset(i for i in range(size) if sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))
    scores = [float(sp.get_score(i)) for i in range(size)]
    plain = [scores[i] for i in range(size) if i not in special]
    if plain and all(s == int(s) and s <= 0 for s in plain) and len(set(plain)) > len(plain) // 2:
        scores = [-math.log(min(-s, size) + 2) for s in scores]
    return Vocabulary(
        tuple(sp.id_to_piece(i) for i in range(size)),
        tuple(scores),
        tuple(bytes_[b] for b in range(256)),
        special,
    )


class Coder:
    """Encoder and decoder of one vocabulary, for use inside a task."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.automaton = ahocorasick.Automaton()
        plain = [(i, p) for i, p in enumerate(vocabulary.pieces) if i not in vocabulary.special and p]
        for i, p in plain:
            self.automaton.add_word(p, (len(p), vocabulary.scores[i], i))
        self.automaton.make_automaton()
        self.byte_score = min((vocabulary.scores[i] for i, _ in plain), default=0.0) - PENALTY
        self.parts = re.compile(self._parts([p for _, p in plain]))
        self.remembered: dict[str, bytes] = {}
        texts = [p.replace(SPACE, " ").encode() for p in vocabulary.pieces]
        for b, i in enumerate(vocabulary.bytes_):
            texts[i] = bytes([b])
        for i in vocabulary.special - set(vocabulary.bytes_):
            texts[i] = b""
        self.flat = np.frombuffer(b"".join(texts), dtype=np.uint8)
        self.length = np.array([len(t) for t in texts], dtype=np.int64)
        self.offset = np.cumsum(self.length) - self.length

    @staticmethod
    def _parts(pieces: list[str]) -> str:
        """A pattern that cuts texts only where no piece goes across, so that parts can be
        encoded one by one and remembered; a vocabulary that leaves no such place gets whole texts.
        """
        if any(SPACE in p.lstrip(SPACE) for p in pieces):
            return "(?s).+"
        line = "" if any("\n" in p for p in pieces) else "\n"
        after_letter = {b for p in pieces for a, b in zip(p, p[1:], strict=False) if a.isalpha()}
        cuts = "".join(re.escape(c) for c in ".,;:!?|#$%&*()<>\"" if c not in after_letter)
        word = f"{SPACE}*[^\\W\\d_]+(?=[{cuts}])|" if cuts else ""
        return (f"{line}|" if line else "") + f"{word}{SPACE}*[^{SPACE}{line}]+|{SPACE}+"

    def best_path(self, part: str) -> list[int]:
        """Ids of the best-scored segmentation; of equals, the one whose last pieces are longer."""
        n, byte_score = len(part), self.byte_score
        best, start, piece = [0.0] * (n + 1), list(range(-1, n)), [-1] * (n + 1)
        done = 0
        for end, (length, score, i) in self.automaton.iter(part):
            end += 1
            while done < end:
                # Before any piece relaxes a place, its last character may come as bytes.
                c = part[done]
                best[done + 1] = best[done] + (byte_score if c < "\x80" else byte_score * len(c.encode("utf-8", "surrogatepass")))
                done += 1
            to = best[end - length] + score
            if to > best[end]:
                best[end], start[end], piece[end] = to, end - length, i
        ids: list[int] = []
        at = n  # what no piece reaches at the end goes as bytes, whatever it costs
        while at > 0:
            if piece[at] >= 0:
                ids.append(piece[at])
            else:
                ids.extend(self.vocabulary.bytes_[b] for b in reversed(part[start[at] : at].encode("utf-8", "surrogatepass")))
            at = start[at]
        return ids[::-1]

    def _coded(self, part: str) -> bytes:
        coded = array("i", self.best_path(part)).tobytes()
        if len(part) <= SHORT:  # long parts hardly come again
            if len(self.remembered) >= REMEMBER:
                self.remembered.clear()
            self.remembered[part] = coded
        return coded

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text; the empty text has none, others begin as if a space stood before them."""
        if not text:
            return np.zeros(0, dtype=np.int32)
        known = self.remembered
        literal = np.array([self.vocabulary.bytes_[b] for b in SPACE.encode()], dtype=np.int32).tobytes()
        out = []
        # A literal space mark would read as a space: it always goes by its bytes.
        for k, stretch in enumerate((" " + text).split(SPACE)):
            if k:
                out.append(literal)
            out += [known.get(p) or self._coded(p) for p in self.parts.findall(stretch.replace(" ", SPACE))]
        return np.frombuffer(b"".join(out), dtype=np.int32)

    def decode(self, ids: np.ndarray) -> str:
        """The text of a sequence of ids; bytes that are no UTF-8 become U+FFFD."""
        lengths = self.length[ids]
        total = int(lengths.sum())
        spots = np.arange(total) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(self.offset[ids], lengths)
        data = self.flat[spots].tobytes()
        return (data[1:] if data[:1] == b" " else data).decode("utf-8", "replace")


_coders: dict[int, Coder] = {}


def _coder(broadcast) -> Coder:
    """One automaton per Python worker and vocabulary."""
    key = hash(broadcast.value.pieces)
    if key not in _coders:
        _coders.clear()
        _coders[key] = Coder(broadcast.value)
    return _coders[key]


def encode_texts(docs: DataFrame, vocabulary: Vocabulary, *, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``id_col`` (long), ``ids`` (array<int>), ``n_tokens`` (long) and ``exact`` per row of ``docs``.

    ``exact`` says that decoding the ids gives back the whole text.  A null text has null ids
    and no tokens; an empty one has an empty array.  Repeated rows are coded one by one, null
    ids pass, other columns are left behind.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(shared)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                texts = part.column(1).to_pylist()
                ids = [None if t is None else coder.encode(t) for t in texts]
                exact = [t is None or coder.decode(i) == t for t, i in zip(texts, ids, strict=True)]
                counts = np.array([0 if i is None else len(i) for i in ids], dtype=np.int64)
                ends = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), mask=np.array([*[i is None for i in ids], False]))
                flat = np.concatenate([i for i in ids if i is not None] or [np.zeros(0, np.int32)])
                yield pa.record_batch(
                    [part.column(0), pa.ListArray.from_arrays(ends, pa.array(flat)), pa.array(counts), pa.array(exact)],
                    names=["id", "ids", "n_tokens", "exact"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    coded = rows.mapInArrow(run, "id long, ids array<int>, n_tokens long, exact boolean")
    return coded.withColumnRenamed("id", id_col)


def decode_ids(coded: DataFrame, vocabulary: Vocabulary, *, id_col: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``id_col`` (long) and ``text`` per row of ``coded``; null ids give null texts."""
    shared = coded.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(shared)
        for batch in batches:
            texts = [None if i is None else coder.decode(np.array(i, dtype=np.int64)) for i in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    rows = coded.select(F.col(id_col).cast("long").alias("id"), F.col(ids).cast("array<int>").alias("ids"))
    return rows.mapInArrow(run, "id long, text string").withColumnRenamed("id", id_col)
