"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point, so that letters
never met in training have theirs, too.  An n-gram is the product of its letters' vectors, each
rotated by its distance from the end; a text is the sum of its n-grams, and a language is the
bundle of its texts.  A text goes to the language with the largest cosine.

Texts are lowered; whatever is no letter becomes one blank, which is a letter of its own
and also stands before and after each text.  Fitting sums the n-grams' weights in each
task, multiplies them out once per task, and adds the few vectors in Spark; sums are of whole numbers and so
don't depend on the order of rows or tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZE = 1024
"""Components of a vector."""

WIDTH = 3
"""Letters of an n-gram; three of 21 bits each fit one long."""

MOST_LANGUAGES = 4096
"""Languages one model may have: the bound of what is brought to the driver and sent to the
tasks (16 MB).  A column with more values raises; it is no language column."""

UNKNOWN = "und"

_SCALE = 1 << 16
_SLICE = 1 << 18
_BLOCK = 4096


class _Space:
    """Vectors of letters and n-grams of one size; pure functions of the code points, with a cache."""

    def __init__(self, size: int, seed: int):
        self.size, self.seed = size, seed
        self.letters: dict[int, np.ndarray] = {}
        self.is_letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)

    def letter(self, code: int) -> np.ndarray:
        vector = self.letters.get(code)
        if vector is None:
            if len(self.letters) >= _BLOCK:
                self.letters.clear()
            bits = np.random.default_rng([self.seed, code]).integers(0, 2, self.size, dtype=np.int8)
            vector = self.letters[code] = (2 * bits - 1).astype(np.int8)
        return vector

    def grams(self, codes: np.ndarray) -> np.ndarray:
        """The vectors of packed n-grams, one row each."""
        product = None
        for turn in range(WIDTH):
            letters, which = np.unique((codes >> (21 * turn)) & 0x1FFFFF, return_inverse=True)
            table = np.stack([np.roll(self.letter(int(c)), turn) for c in letters])
            product = table[which] if product is None else product * table[which]
        return product

    def count(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Packed n-grams of a text and how often each occurs; nothing if it has no letter."""
        found, times = [], []
        tail, any_letter = np.zeros(1, np.int64), False
        for start in range(0, len(text), _SLICE):
            part = text[start : start + _SLICE].lower().encode("utf-32-le", "surrogatepass")
            codes = np.frombuffer(part, np.uint32).astype(np.int64)
            letter = self.is_letter[codes]
            any_letter = any_letter or bool(letter.any())
            before = np.concatenate(([tail[-1] != 0], letter[:-1]))
            tail = self._add(tail, np.where(letter, codes, 0)[letter | before], found, times)
        if not any_letter:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        if tail[-1] != 0:
            self._add(tail, np.zeros(1, np.int64), found, times)
        return _summed(np.concatenate(found), np.concatenate(times))

    @staticmethod
    def _add(tail, codes, found, times) -> np.ndarray:
        """Count the n-grams that end in ``codes``; returns the last letters for the next part."""
        codes = np.concatenate((tail, codes))
        n = len(codes) - WIDTH + 1
        if n > 0:
            packed = np.zeros(n, np.int64)
            for i in range(WIDTH):
                packed = (packed << 21) | codes[i : i + n]
            grams, often = np.unique(packed, return_counts=True)
            found.append(grams)
            times.append(often)
        return codes[-(WIDTH - 1) :]


def _summed(codes: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each code once, with the sum of its weights."""
    unique, which = np.unique(codes, return_inverse=True)
    sums = np.zeros(len(unique), np.int64)
    np.add.at(sums, which, weights)
    return unique, sums


_spaces: dict[tuple[int, int], _Space] = {}


def _space(size: int, seed: int) -> _Space:
    """One space per process: its tables are the same whoever asks."""
    if (size, seed) not in _spaces:
        _spaces[size, seed] = _Space(size, seed)
    return _spaces[size, seed]


@dataclass(frozen=True)
class Profiles:
    """Names of languages, ascending, and their vectors of length one."""

    names: list[str]
    vectors: np.ndarray = field(repr=False)
    size: int = SIZE
    seed: int = 0


def _bundles(size: int, seed: int):
    """Arrow batches of (lang, text) to the task's sum per language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, sums, waiting = _space(size, seed), {}, {}

        def bundle(lang):
            codes, weights = _summed(*map(np.concatenate, zip(*waiting.pop(lang))))
            total = sums.setdefault(lang, np.zeros(size, np.int64))
            for i in range(0, len(codes), _BLOCK):
                total += weights[i : i + _BLOCK] @ space.grams(codes[i : i + _BLOCK]).astype(np.int64)

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                codes, times = space.count(text)
                if len(codes):
                    # Nearly orthogonal vectors: this is the length of the text's vector in units of sqrt(size).
                    length = float(np.sqrt((times.astype(np.float64) ** 2).sum()))
                    held = waiting.setdefault(lang, [])
                    held.append((codes, np.rint(times * (_SCALE / length)).astype(np.int64)))
                    if len(codes) > _BLOCK or len(held) >= 256:
                        bundle(lang)
        for lang in list(waiting):
            bundle(lang)
        if sums:
            names = sorted(sums)
            yield pa.RecordBatch.from_pydict(
                {"lang": pa.array(names, pa.string()), "bundle": pa.array([sums[n] for n in names], pa.list_(pa.int64()))}
            )

    return run


def fit(docs: DataFrame, *, text: str = "text", lang: str = "lang", size: int = SIZE, seed: int = 0) -> Profiles:
    """Profiles of the languages in ``lang``, from all rows of ``docs`` with a language and a letter.

    Every text counts alike, whatever its length; repeated rows count as often as they occur.
    Rows without language, text or letter teach nothing; without any rows there are no languages.
    Other columns are not read.  More than ``MOST_LANGUAGES`` languages raise.
    """
    rows = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    parts = rows.mapInArrow(_bundles(size, seed), "lang string, bundle array<bigint>")
    sums = parts.select("lang", F.posexplode("bundle").alias("at", "x")).groupBy("lang", "at").agg(F.sum("x").alias("x"))
    whole = sums.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("at", "x"))).alias("v"))  # size entries each
    found = sorted(whole.select("lang", "v.x").limit(MOST_LANGUAGES + 1).collect())
    if len(found) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages in {lang}")
    vectors = np.array([r.x for r in found], np.float64).reshape(len(found), size)
    lengths = np.linalg.norm(vectors, axis=1, keepdims=True)
    return Profiles([r.lang for r in found], vectors / np.where(lengths == 0, 1, lengths), size, seed)


def _cosines(space: _Space, texts: list[tuple[np.ndarray, np.ndarray]], profiles: Profiles) -> np.ndarray:
    """One row of cosines with the languages per counted text."""
    codes, which = np.unique(np.concatenate([c for c, _ in texts]), return_inverse=True)
    times = np.concatenate([t for _, t in texts])
    row = np.repeat(np.arange(len(texts)), [len(c) for c, _ in texts])
    order = np.argsort(which, kind="stable")
    which, times, row = which[order], times[order], row[order]
    vectors = np.zeros((len(texts), space.size))
    for start in range(0, len(codes), _BLOCK):
        a, b = np.searchsorted(which, (start, start + _BLOCK))
        grams = space.grams(codes[start : start + _BLOCK]).astype(np.float32)
        block = np.zeros((len(texts), len(grams)), np.float32)
        block[row[a:b], which[a:b] - start] = times[a:b]
        vectors += block @ grams
    lengths = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors @ profiles.vectors.T / np.where(lengths == 0, 1, lengths)


def _classifier(profiles: Profiles):
    """A function of the text column; Spark sends it texts in Arrow batches."""

    @F.pandas_udf("lang string, score double")
    def classify(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        space = _space(profiles.size, profiles.seed)
        for batch in batches:
            names, scores = [UNKNOWN] * len(batch), np.zeros(len(batch))
            held: list[tuple[int, tuple]] = []

            def settle():
                if held:
                    cosines = _cosines(space, [c for _, c in held], profiles)
                    best = cosines.argmax(axis=1)  # ties go to the first name
                    for (i, _), k, row in zip(held, best, cosines):
                        names[i], scores[i] = profiles.names[k], min(1.0, max(0.0, row[k]))
                    held.clear()

            if profiles.names:
                grams = 0
                for i, text in enumerate(batch):
                    counted = space.count(text) if isinstance(text, str) else None
                    if counted is not None and len(counted[0]):
                        held.append((i, counted))
                        grams += len(counted[0])
                        if len(held) >= 64 or grams >= _SLICE:
                            settle()
                            grams = 0
                settle()
            yield pd.DataFrame({"lang": names, "score": scores})

    return classify


def language_of(text: Column, profiles: Profiles) -> Column:
    """Struct of ``lang`` and ``score`` (the cosine, negative ones as 0) of a text column.

    Null texts, texts without a letter, and any text if nothing was learned get ``und`` and 0.
    Equal cosines go to the first language by name.
    """
    return _classifier(profiles)(text)


def identify(docs: DataFrame, profiles: Profiles, *, text: str = "text", out: str = "language") -> DataFrame:
    """``docs`` with a struct ``out`` of ``lang`` and ``score``, row by row: repeated rows get equal
    answers, an empty table gives an empty one, columns may have any name but ``out``."""
    if out in docs.columns:
        raise ValueError(f"{out} is already a column")
    names = [f"c{i}" for i in range(len(docs.columns))]
    inner = docs.toDF(*names)
    return inner.withColumn("_out", language_of(F.col(names[docs.columns.index(text)]), profiles)).toDF(*docs.columns, out)
