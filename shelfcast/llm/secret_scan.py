"""Secret scan: candidate strings judged by a random forest, to take false alarms out.

Candidates are long runs of key characters with a digit, values of any length and alphabet
assigned to a credential's name, and known formats.  Each gets features of its length
and characters, of how likely its character transitions are in ordinary words, of how much
of it a dictionary covers, of the path it was found under and of the words beside it.  A
random forest (``spark.ml``, so training is Spark's) learns from labelled findings which
candidates are secrets.  Dictionary and transitions come from the words of all documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.session import materialise

LEAST_LENGTH = 12
# The dictionary: words that make up this share of all words at least, whatever the size of the
# corpus.  There can be at most 1 / DICTIONARY of them, which bounds the broadcast.
DICTIONARY = 5e-6
# Labelled findings read for training at most, those whose hash is least: a documented bound.
SAMPLE = 20_000
TREES, DEPTH, SEED = 24, 6, 11

_CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{%d,}" % LEAST_LENGTH)
# A value assigned to a credential's name: quoted, or up to the next white space.  Short names need a
# border before them (monkey is no key), and what follows a name is a part of its own (secretary is no secret).
_ASSIGNED = re.compile(
    r"(?:(?i:password|passwd|passphrase|secret|token|api[_-]?key|credential)|(?<![A-Za-z])(?i:pass|pwd|key|api|auth|private|access|bearer|login)"
    r"|(?<=[a-z0-9])(?:Pass|Pwd|Key|Auth))(?:s|S)?(?:[_-][A-Za-z0-9_-]{0,40}|[A-Z0-9][A-Za-z0-9_-]{0,40})?"
    r"[\"'`]?[ \t]{0,8}(?::=|=>|==?|:)[ \t]{0,8}(?:\"([^\"\n]+)\"|'([^'\n]+)'|`([^`\n]+)`|([^\s\"'`]))"
)
_GAP = re.compile(r"\s")
# Formats that are known by their start.
_FORMAT = re.compile(
    r"(?<![A-Za-z0-9_-])(?:AKIA[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{16,}|sk[-_][A-Za-z0-9_-]{16,}|xox[a-z]-[A-Za-z0-9-]{10,}"
    r"|eyJ[A-Za-z0-9_-]{6,}\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*|AIza[A-Za-z0-9_-]{30,}|glpat-[A-Za-z0-9_-]{16,})(?![A-Za-z0-9_-])"
)
_WORD = re.compile(r"[^\W\d_]+")
# Words that tend to stand beside secrets, beside other long strings, and in
# paths of samples.
NEAR = "password passwd pwd secret token key apikey api auth credential private access bearer login".split()
AWAY = "hash sha md5 commit uuid id isbn doi checksum digest version serial order invoice phone tel card".split()
SAMPLE_PATHS = "test tests example examples sample samples doc docs fixture fixtures mock demo".split()

FEATURES = (
    "length lower upper digit other distinct entropy class_changes transition coverage assigned quoted near_words away_words "
    "near_dist known_prefix hex_only digits_only path_depth path_sample path_code right_word"
).split()


@dataclass(frozen=True)
class Language:
    """What ordinary words look like: the dictionary and log probabilities of letter after letter."""

    words: frozenset[str]
    transitions: np.ndarray


def language(docs: DataFrame, *, text: str = "text", share: float = DICTIONARY) -> Language:
    """The words with a ``share`` of all words of all documents, and the transitions of every word, counted by Spark."""
    words = docs.select(F.explode(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), "[^\\p{L}]+")).alias("w"))
    words = materialise(words.where("w <> ''").groupBy("w").agg(F.count(F.lit(1)).alias("n")), "words")
    # Sums of 128 x 128 pairs of letters: combined in every task, and as many rows in the driver.
    letters = F.concat(F.array(F.lit(" ")), F.filter(F.split("w", ""), lambda c: c.between("\x01", "\x7f")), F.array(F.lit(" ")))
    pairs = words.select("n", letters.alias("l")).select(
        "n", F.explode(F.arrays_zip(F.slice("l", F.lit(1), F.size("l") - 1).alias("a"), F.slice("l", F.lit(2), F.size("l") - 1).alias("b"))).alias("p")
    )
    pairs = pairs.groupBy(F.ascii("p.a").alias("a"), F.ascii("p.b").alias("b")).agg(F.sum("n").alias("n")).toPandas()
    counts = np.ones((128, 128))
    counts[pairs["a"].to_numpy(dtype=int), pairs["b"].to_numpy(dtype=int)] += pairs["n"].to_numpy(dtype=float)
    total = words.agg(F.sum("n")).first()[0] or 0
    known = words.where(F.length("w").between(3, 24) & (F.col("n") >= F.lit(total * share))).select("w").toPandas()["w"]
    return Language(frozenset(known), np.log(counts / counts.sum(axis=1, keepdims=True)))


def _kind(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


def _coverage(s: str, words: frozenset[str]) -> float:
    """Share of characters in dictionary words, taken longest first from the left."""
    i = covered = 0
    low = s.lower()
    while i < len(low):
        for n in range(min(12, len(low) - i), 2, -1):
            if low[i : i + n] in words:
                covered += n
                i += n
                break
        else:
            i += 1
    return covered / len(low)


def features(s: str, left: str, right: str, path: str | None, lang: Language) -> list[float]:
    """The numbers of ``FEATURES`` for a candidate between two stretches of text."""
    kinds = [_kind(c) for c in s]
    n = len(s)
    counts = np.unique([ord(c) for c in s], return_counts=True)[1] / n
    codes = np.array([32, *[min(ord(c), 127) for c in s.lower()], 32])
    before = [w.lower() for w in _WORD.findall(left)][-4:]
    path = (path or "").lower()
    parts = re.split(r"[^a-z0-9]+", path)
    lead = left.rstrip()[-1:] or " "
    unquoted = left.rstrip().rstrip("\"'`").rstrip()[-1:]
    near = [k for k, w in enumerate(reversed(before)) if any(x in w for x in NEAR)]
    away = sum(w in AWAY for w in before)
    return [
        float(n),
        *[kinds.count(k) / n for k in range(4)],
        len(set(s)) / n,
        float(-(counts * np.log2(counts)).sum()),
        sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / max(1, n - 1),
        float(lang.transitions[codes[:-1], codes[1:]].mean()),
        _coverage(s, lang.words),
        float((unquoted in "=:" and unquoted != "") or left.rstrip().rstrip("\"'`").rstrip().endswith("=>")),
        float(lead in "\"'`"),
        float(len(near)),
        float(away),
        float(min(near, default=9)),
        float(bool(re.match(r"AKIA[A-Z0-9]{16}$|gh[pousr]_|sk[-_]|xox[a-z]-|eyJ|AIza|glpat-", s))),
        float(bool(re.fullmatch("[0-9a-f]+|[0-9A-F]+", s))),
        float(s.isdigit()),
        float(path.count("/")),
        float(any(p in SAMPLE_PATHS for p in parts)),
        float(bool(re.search(r"\.(py|js|ts|java|go|rb|sh|ya?ml|json|env|conf|ini|cfg|xml|toml)$", path))),
        float(bool(_WORD.match(right.lstrip()[:12]))),
    ]


def spans(body: str) -> list[tuple[int, int]]:
    """Start and end of each candidate of a text, ascending, none twice."""
    found = {m.span() for m in _CANDIDATE.finditer(body) if any(c.isdigit() for c in m.group())}
    found.update(m.span() for m in _FORMAT.finditer(body))
    m, gap = _ASSIGNED.search(body), 0
    while m:
        a, b = m.span(m.lastindex)
        # A value may hold a name and its value: url=x?token=y.
        following = _ASSIGNED.search(body, a)
        if m.lastindex == 4:
            if gap <= a:
                white = _GAP.search(body, a)
                gap = white.start() if white else len(body)
            # Unquoted, it ends at white space or where the next name begins, so that values share no text.
            end = min(gap, following.start()) if following else gap
            b = a + (len(body[a:end].rstrip(",;\"'`&?|")) or end - a)
        if b > a:
            found.add((a, b))
        m = following
    return sorted(found)


def candidates(docs: DataFrame, lang: Language, *, id_col: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """A row per candidate: ``id_col`` (long), ``start`` (code points), ``finding``, ``left`` (60 characters before) and ``features``.

    Whole texts are searched; null and empty texts have no candidates.  ``path`` names a
    column with the place of the text, if there is one.  Repeated rows repeat candidates, an empty
    table gives an empty one, and other columns are not read, whatever their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(lang)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for key, body, where in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                for a, b in spans(body or ""):
                    s, left, right = body[a:b], body[max(0, a - 60) : a], body[b : b + 30]
                    rows.append((key, a, s, left, features(s, left, right, where, shared.value)))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.float64())]
            yield pa.record_batch([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names=["id", "start", "finding", "left", "features"])

    place = F.col(path).cast("string") if path else F.lit(None).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"), place.alias("path"))
    found = rows.mapInArrow(run, "id long, start long, finding string, left string, features array<double>")
    return found.withColumnRenamed("id", id_col)


def judge(found: DataFrame, labelled: DataFrame, *, label: str = "label", sample: int = SAMPLE) -> DataFrame:
    """``found`` with ``score`` (share of the forest's votes for a secret) and ``is_secret``.

    ``labelled`` holds ``features`` and a 0/1 ``label`` per finding; unlabelled rows are left
    out and at most ``sample`` findings are read.  With one class among them its label
    answers for all, with none every candidate counts as a secret (score 0.5).
    """
    known = labelled.where(F.col(label).isNotNull()).select("features", F.col(label).cast("double").alias("label"))
    known = materialise(known.orderBy(F.xxhash64("features", "label"), "features", "label").limit(sample), "findings")
    classes = sorted(r[0] for r in known.select("label").distinct().collect())
    if len(classes) < 2:
        score = F.lit(classes[0] if classes else 0.5)
        return found.withColumn("score", score).withColumn("is_secret", (score >= 0.5).cast("int"))
    forest = RandomForestClassifier(
        featuresCol="_vector", labelCol="label", probabilityCol="_probability", rawPredictionCol="_raw", predictionCol="_prediction",
        numTrees=TREES, maxDepth=DEPTH, seed=SEED, maxBins=64, cacheNodeIds=False,
    )
    model = forest.fit(known.withColumn("_vector", array_to_vector("features")))
    voted = model.transform(found.withColumn("_vector", array_to_vector("features")))
    score = F.get(vector_to_array("_probability"), F.lit(1))
    return voted.withColumn("score", score).withColumn("is_secret", (F.col("score") >= 0.5).cast("int")).drop("_vector", "_raw", "_probability", "_prediction")


def rule_labels(found: DataFrame) -> DataFrame:
    """Labels from plain rules, for corpora without reviewed findings: known formats and values
    assigned to a credential's name are secrets unless they are dictionary words without quotes, bare numbers and values beside words for
    checksums are not, the rest has no label.
    """
    f = {name: F.col("features")[i] for i, name in enumerate(FEATURES)}
    word = (f["coverage"] >= 0.9) & (f["quoted"] == 0)
    secret = (f["known_prefix"] == 1) | ((f["assigned"] == 1) & (f["near_dist"] == 0) & (f["digits_only"] == 0) & ~word)
    other = (f["digits_only"] == 1) | ((f["away_words"] > 0) & (f["near_words"] == 0))
    return found.withColumn("label", F.when(secret, 1).when(other, 0))
