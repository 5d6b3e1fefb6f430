"""Toxicity by subword bags: averaged character n-gram vectors and a linear softmax.

A word's vector is the mean of the vectors of its character n-grams (3 to 6 bytes, with
marks for its ends) and of the word itself, all hashed into one table; the mean over the
words of a window is scored by a linear softmax of two classes.  A text takes the average
of its windows' scores weighted by the softmax of those scores, so that one bad passage in
a long text counts; windows tile the whole text.  Table and weights are trained together in
numpy on a bounded sample of labelled rows.  A misspelt word shares most of
its n-grams with the known one, so it lands near it.

Scoring is a map over Arrow batches: the words of a batch are told apart by hash, each
different word is scored once, and windows average the scores of their words.  No row leaves
its partition, and only the model (fixed size) is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.llm.shingles import span_hashes, word_spans
from shelfcast.session import materialise

# Size of the table and of its vectors, n-gram lengths in bytes.
BUCKETS = 1 << 20
DIM = 8
GRAMS = (3, 4, 5, 6)
# At most so many labelled rows of each class are read for training, the ones whose hashed
# id is least.  A documented bound of the fit; scoring covers every row.
SAMPLE = 3_000
# Windows of a text have so many words at most.
WINDOW = 24
# Passes, texts of a step, step sizes of the three blocks, shrinkage of the table per step.
EPOCHS = 6
BATCH = 128
RATES = (0.2, 0.05, 0.05)
DECAY = 5e-3
EPS = 1e-5
# An n-gram is trained if it is in this share of the training texts, and in 5 at least.
LEAST_SHARE = 0.01
THRESHOLD = 0.7
SLICE = 512

# Letters, digits and non-ASCII bytes make words; other ASCII bytes separate them.
_GAP = np.ones(256, dtype=bool)
_GAP[128:] = False
for _range in (b"09", b"AZ", b"az"):
    _GAP[_range[0] : _range[1] + 1] = False


@dataclass
class Model:
    table: np.ndarray
    weights: np.ndarray
    bias: np.ndarray


@dataclass
class _Bags:
    """Windows as bags of words: word index of every word in order, bounds of windows and texts."""

    words: np.ndarray
    at: np.ndarray
    text_at: np.ndarray
    grams: np.ndarray
    gram_at: np.ndarray


def _bags(texts: pa.Array) -> _Bags:
    data, starts, ends, at = word_spans(texts, _GAP)
    hashes = span_hashes(data, starts, ends)
    different, first, words = np.unique(hashes, return_index=True, return_inverse=True)
    # Each different word once, between two marks.
    lengths = ends[first] - starts[first]
    where = np.concatenate([[0], np.cumsum(lengths + 2)])
    marked = np.empty(where[-1], dtype=np.uint8)
    marked[where[:-1]] = ord("<")
    marked[where[1:] - 1] = ord(">")
    inside = np.ones(len(marked), dtype=bool)
    inside[where[:-1]] = False
    inside[where[1:] - 1] = False
    spot = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(starts[first], lengths)
    marked[inside] = data[spot]
    owner = np.repeat(np.arange(len(different)), lengths + 2)
    begin, stop, own = [where[:-1]], [where[1:]], [np.arange(len(different))]
    places = np.arange(len(marked))
    for n in GRAMS:
        # All n-grams but the word's whole, which is there already.
        ok = (places + n <= where[owner + 1]) & (lengths[owner] + 2 != n)
        begin.append(places[ok])
        stop.append(places[ok] + n)
        own.append(owner[ok])
    begin, stop, own = map(np.concatenate, (begin, stop, own))
    order = np.argsort(begin, kind="stable")  # grams of one word stay together
    begin, stop, own = begin[order], stop[order], own[order]
    grams = (span_hashes(marked, begin, stop) % np.uint64(BUCKETS)).astype(np.int32)
    # Windows tile each text evenly: as many as needed, none longer than WINDOW words.
    n = np.diff(at)
    windows = -(-n // WINDOW)
    text_at = np.concatenate([[0], np.cumsum(windows)])
    of = np.repeat(np.arange(len(n)), windows)
    nth = np.arange(text_at[-1]) - text_at[of]
    bounds = np.concatenate([at[of] + nth * n[of] // windows[of], at[-1:]])
    return _Bags(words, bounds, text_at, grams, np.searchsorted(own, np.arange(len(different) + 1)))


def _segment_mean(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Means of consecutive rows; empty segments are zero."""
    sums = np.concatenate([np.zeros((1, values.shape[1]), np.float64), np.cumsum(values, axis=0, dtype=np.float64)])
    n = np.diff(at)
    return (sums[at[1:]] - sums[at[:-1]]) / np.maximum(n, 1)[:, None]


def _texts_with(bag: _Bags) -> np.ndarray:
    """For each bucket in how many texts of the bag it occurs."""
    seen = np.zeros(BUCKETS, np.int32)
    for a, b in zip(bag.at[bag.text_at[:-1]], bag.at[bag.text_at[1:]], strict=True):
        words = np.unique(bag.words[a:b])
        if len(words):
            counts = bag.gram_at[words + 1] - bag.gram_at[words]
            spots = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(bag.gram_at[words], counts)
            seen[np.unique(bag.grams[spots])] += 1
    return seen


def _pool(scores: np.ndarray, text_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores of texts from those of their windows, and each window's derivative."""
    n = np.diff(text_at)
    of = np.repeat(np.arange(len(n)), n)
    top = np.full(len(n), -np.inf)
    np.maximum.at(top, of, scores)
    e = np.exp(scores - top[of])
    weight = e / np.bincount(of, e, minlength=len(n))[of]
    pooled = np.bincount(of, weight * scores, minlength=len(n))
    return pooled, weight * (1 + scores - pooled[of])


def train(texts: pa.Array, labels: np.ndarray, *, seed: int = 7, epochs: int = EPOCHS) -> Model:
    """Fit table, weights and bias together with Adam on the cross entropy.

    N-grams in too few of the training texts keep the zero vector.  Both classes
    have the same weight.  With a single class, or none, the bias alone answers.
    """
    rng = np.random.default_rng(seed)
    labels = np.asarray(labels, dtype=np.int64)
    table = np.zeros((BUCKETS, DIM), np.float32)
    if len(set(labels.tolist())) < 2:
        bias = 0 if not len(labels) else (6 if labels[0] else -6)
        return Model(table, np.zeros((DIM, 2), np.float32), np.array([0, bias], np.float32))
    share = np.bincount(labels, minlength=2) / len(labels)
    order = rng.permutation(len(labels))
    picks = [order[i : i + BATCH] for i in range(0, len(order), BATCH)]
    batches = [(_bags(texts.take(pa.array(pick))), labels[pick]) for pick in picks]
    known = np.flatnonzero(sum(_texts_with(bag) for bag, _ in batches) >= max(5, LEAST_SHARE * len(labels)))
    # Only known n-grams are trained: a small table whose last row stays zero stands for the rest.
    small = np.full(BUCKETS, len(known), np.int32)
    small[known] = np.arange(len(known), dtype=np.int32)
    for bag, _ in batches:
        bag.grams = small[bag.grams]
    part = np.zeros((len(known) + 1, DIM), np.float32)
    params = (part, (rng.random((DIM, 2)) - 0.5).astype(np.float32) * 2, np.zeros(2, np.float32))
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    total, done = epochs * len(batches), 0
    for _ in range(epochs):
        for i in rng.permutation(len(batches)):
            bag, y = batches[i]
            word = _segment_mean(part[bag.grams], bag.gram_at)
            mean = _segment_mean(word[bag.words], bag.at)
            logits = mean @ params[1] + params[2]
            pooled, slope = _pool(logits[:, 1] - logits[:, 0], bag.text_at)
            wrong = (1 / (1 + np.exp(-np.clip(pooled, -60, 60))) - y) * 0.5 / share[y] / len(y)
            wrong = wrong[np.repeat(np.arange(len(y)), np.diff(bag.text_at))] * slope
            p = np.stack([-wrong, wrong], axis=1)
            to_mean = p @ params[1].T.astype(np.float64)
            n_words, n_grams = np.diff(bag.at), np.diff(bag.gram_at)
            scale = (to_mean / np.maximum(n_words, 1)[:, None])[np.repeat(np.arange(len(n_words)), n_words)]
            to_word = np.stack([np.bincount(bag.words, scale[:, k], minlength=len(n_grams)) for k in range(DIM)], axis=1)
            per_gram = np.repeat(to_word / np.maximum(n_grams, 1)[:, None], n_grams, axis=0)
            to_part = np.stack([np.bincount(bag.grams, per_gram[:, k], minlength=len(part)) for k in range(DIM)], axis=1)
            to_part[-1] = 0
            done += 1
            for j, grad in enumerate((to_part, mean.T @ p, p.sum(axis=0))):
                grad = grad.astype(np.float32)
                m, v = state[j]
                m += 0.1 * (grad - m)
                v += 0.01 * (grad**2 - v)
                rate = RATES[j] * (1 - done / (total + 1))
                params[j][...] -= rate * (m / (1 - 0.9**done)) / (np.sqrt(v / (1 - 0.99**done)) + EPS)
            part *= 1 - DECAY
    table[known] = part[:-1]
    return Model(table, params[1], params[2])


def score(model: Model, texts: pa.Array) -> np.ndarray:
    """The probability of the toxic class for each text; one without words gets the bias's."""
    diff = (model.table @ (model.weights[:, 1] - model.weights[:, 0])).astype(np.float32)
    return window_score(diff, float(model.bias[1] - model.bias[0]), texts)


def window_score(diff: np.ndarray, bias: float, texts: pa.Array) -> np.ndarray:
    """As ``score``, from what the linear softmax makes of each n-gram: one number a bucket."""
    bag = _bags(texts)
    word = _segment_mean(diff[bag.grams][:, None], bag.gram_at)
    windows = _segment_mean(word[bag.words], bag.at)[:, 0] + bias
    pooled, _ = _pool(windows, bag.text_at)
    pooled = np.where(np.diff(bag.text_at) == 0, bias, pooled)
    return 1 / (1 + np.exp(-np.clip(pooled, -60, 60)))


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> Model:
    """Train on the labelled rows of ``docs``: per class the ``sample`` ones whose hashed id is least.

    Rows without a label or an id don't take part; an id labelled more than once is toxic if
    any label says so.  Without labelled rows the model answers 0.5 for everything.
    """
    one = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label).alias("_label"))
    order = F.xxhash64("_id")
    chosen = one.where("_label = 1").orderBy(order, "_id").limit(sample).unionByName(
        one.where("_label = 0").orderBy(order, "_id").limit(sample)
    )
    chosen = materialise(chosen, "sample")
    # Two samples of fixed size: safe to broadcast, and the texts to the driver are as many.
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(chosen), "_id")
    rows = rows.select("_id", "_text", F.col("_label").cast("int").alias("_label")).toArrow().sort_by([("_id", "ascending"), ("_text", "ascending")])
    return train(rows["_text"].combine_chunks(), rows["_label"].to_numpy())


def scored(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``id_col`` (long), ``score`` (0 to 1) and ``predicted`` for each row of ``docs``.

    Only the text is looked at.  A null or empty text, or one without letters or digits, gets
    the score of the bias; repeated rows and ids are scored one by one, an empty table gives
    an empty one; other columns are left behind, whatever their names.
    """
    diff = (model.table @ (model.weights[:, 1] - model.weights[:, 0])).astype(np.float32)
    shared = docs.sparkSession.sparkContext.broadcast((diff, float(model.bias[1] - model.bias[0])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, bias = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                yield pa.record_batch([part.column(0), pa.array(window_score(table, bias, part.column(1)))], names=["id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    out = rows.mapInArrow(run, "id long, score double")
    return out.select(F.col("id").alias(id_col), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
