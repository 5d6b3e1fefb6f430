"""Mixing to target weights by soft membership.

A classifier trained on a labelled table gives every document a posterior over domains.
Documents get nonnegative rates so that the expected tokens of each domain, the sum over
documents of rate * tokens * posterior, match the targets in least squares.  The fit is a
projected gradient over all documents: each step is one aggregation to a number per domain
and one expression per row.

Everything runs on DataFrame expressions: no Python function, and only tables of fixed size
(the classifier's weights, sums per domain) reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.llm.tables import words_of
from shelfcast.session import materialise

# Hash classes of words the classifier knows, labelled documents it reads at most (those whose
# hashed id is least; a documented bound), and the divisors of its evidence that are tried.
FEATURES = 1 << 13
SAMPLE = 20_000
TEMPERATURES = (1.0, 1.5, 2.0, 3.0, 4.0, 6.0, 8.0, 12.0, 16.0, 32.0)
# The fit is done when the misfit is this share of the targets, or a further step takes off less than ``GAIN``.
TOLERANCE = 1e-4
GAIN = 1e-5
# Length of a step, in units of one over all tokens, and passes over the documents at most (some 20 are usual).
LENGTH = 1e8
PASSES = 200


def _feature(word: Column) -> Column:
    return F.pmod(F.xxhash64(F.lower(word)), F.lit(FEATURES)).cast("int")


def _numbers(values: Sequence[float]) -> Column:
    """A constant array: literals are folded to one value before the plan runs."""
    return F.expr(f"array({', '.join(f'{float(x)!r}D' for x in values)})")


def _entry(table: Column):
    return lambda at: F.get(table, at)


@dataclass(frozen=True)
class Classifier:
    """Domains in order; per domain a log prior and log ratios of hashed words against the first domain's."""

    domains: list[str]
    prior: list[float]
    words: list[list[float]]
    temperature: float = 1.0

    def evidence(self, text: Column) -> Column:
        """Sums of the log ratios over the distinct words of a text, as an array."""
        hashed = F.array_distinct(F.transform(words_of(text), _feature))
        tables = [_numbers(t) for t in self.words[1:]]

        def sums(h: Column) -> Column:
            each = [F.aggregate(F.transform(h, _entry(t)), F.lit(0.0), lambda s, x: s + x) for t in tables]
            return F.array(F.lit(0.0), *each)

        # One-element arrays name a value, so that it is computed once.
        return F.transform(F.array(hashed), sums)[0]

    def posterior(self, evidence: Column, temperature: float | None = None) -> Column:
        """Posterior of each domain, in their order; without words it is the prior."""
        heat = temperature or self.temperature
        scores = F.zip_with(evidence, _numbers(self.prior), lambda e, p: e / F.lit(heat) + p)
        e = F.transform(F.array(scores), lambda s: F.transform(s, lambda x: F.exp(x - F.array_max(s))))[0]
        return F.transform(F.array(e), lambda v: F.transform(v, lambda x: x / F.aggregate(v, F.lit(0.0), lambda a, b: a + b)))[0]


def train(docs: DataFrame, labelled: DataFrame, *, id_col: str, text: str, domain: str, sample: int = SAMPLE) -> Classifier:
    """Naive Bayes over the distinct words of labelled documents, softened on a part left out.

    Two thirds of the sample count words; on the last third the temperature that divides the
    evidence is chosen by likelihood, so that posteriors are as soft as they are right.
    Rows without an id or a domain don't take part, and an id labelled twice counts with its
    first domain in order.
    """
    one = labelled.where(F.col(id_col).isNotNull() & F.col(domain).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.min(F.col(domain).cast("string")).alias("_domain"))
    chosen = materialise(one.orderBy(F.xxhash64("_id"), "_id").limit(sample), "sample")
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(chosen), "_id")  # ``sample`` rows
    rows = materialise(rows.select("_domain", "_text", (F.pmod(F.xxhash64("_id", F.lit(2)), F.lit(3)) == 0).alias("_aside")), "labelled")
    sizes = {r[0]: r[1] for r in rows.groupBy("_domain").count().collect()}
    domains = sorted(sizes)
    words = rows.where("NOT _aside").select("_domain", F.explode(F.array_distinct(F.transform(words_of(F.col("_text")), _feature))).alias("_w"))
    counts = words.groupBy("_domain", "_w").agg(F.count(F.lit(1)).alias("_n")).collect()  # domains * FEATURES rows at most
    table = {d: [1.0] * FEATURES for d in domains}
    for d, w, n in counts:
        table[d][w] += n
    logs = []
    for d in domains:
        total = sum(table[d])
        logs.append([math.log(x / total) for x in table[d]])
    ratios = [[x - y for x, y in zip(row, logs[0], strict=True)] for row in logs]
    plain = Classifier(domains, [math.log(sizes[d] / sum(sizes.values())) for d in domains], ratios)
    if not domains:
        return plain
    aside = rows.where("_aside").select(F.array_position(F.array(*[F.lit(d) for d in domains]), F.col("_domain")).cast("int").alias("_y"), plain.evidence(F.col("_text")).alias("_e"))
    fits = [F.sum(F.log(F.element_at(plain.posterior(F.col("_e"), t), F.col("_y")) + F.lit(1e-12))).alias(f"t{i}") for i, t in enumerate(TEMPERATURES)]
    likelihood = materialise(aside, "aside").agg(*fits).first()
    best = max(range(len(TEMPERATURES)), key=lambda i: (likelihood[i] if likelihood[i] is not None else 0.0, -i))
    return replace(plain, temperature=TEMPERATURES[best])


def _solve(a: list[list[float]], b: list[float]) -> list[float]:
    """Solution of a small symmetric system (one row per domain) by elimination."""
    n = len(b)
    m = [[*row, y] for row, y in zip(a, b, strict=True)]
    for i in range(n):
        p = max(range(i, n), key=lambda r: abs(m[r][i]))
        m[i], m[p] = m[p], m[i]
        for r in range(n):
            if r != i:
                f = m[r][i] / m[i][i]
                m[r] = [x - f * y for x, y in zip(m[r], m[i], strict=True)]
    return [m[i][n] / m[i][i] for i in range(n)]


def fit_rates(soft: DataFrame, targets: Sequence[float], *, least: str | None = None) -> tuple[DataFrame, float]:
    """``soft`` (``tokens`` long, ``posterior`` array, other columns) with ``rate``, and the misfit that is left.

    Projected gradient on the squared misfit of the expected domain totals, over rates of at
    least 0 (or of column ``least``), from rate 1: every document moves against its part of the gradient, its posterior times
    the misfit, and is projected back.  The gradient is taken where the step lands, so that steps may be long
    without overshooting; a long one nearly reaches the least misfit there is.  What it has to be is a handful of numbers (one per
    domain): Newton's method on a convex function of them, shortened where that doesn't go down.
    The misfit is returned as a share of the targets' sum.

    Every pass is one aggregation over the documents, of which the totals and moments (some
    numbers per pair of domains) reach the driver.
    """
    k = len(targets)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    bound = F.col(least).cast("double") if least else F.lit(0.0)
    p = [F.get(F.col("posterior"), F.lit(i)) for i in range(k)]
    n = F.col("tokens").cast("double")
    now = soft.withColumn("rate", F.greatest(bound, F.lit(1.0)))
    tokens = soft.agg(F.sum(n)).first()[0] or 0.0
    size = sum(targets)
    if tokens <= 0 or size <= 0:
        return now, 0.0 if size <= 0 else 1.0
    aims = [t / tokens for t in targets]

    def free(move: Sequence[float]) -> Column:
        """Rates after a move, before they are projected."""
        moves = _numbers(move)
        return F.col("rate") - sum((F.get(moves, F.lit(j)) * p[j] for j in range(1, k)), F.get(moves, F.lit(0)) * p[0])

    def landed(move: Sequence[float]) -> tuple[float, list[float], list[list[float]]]:
        """The convex function, its gradient and its second derivatives at a move."""
        at = now.select("*", free(move).alias("_free"))
        inside = F.col("_free") > bound
        rate = F.when(inside, F.col("_free")).otherwise(bound)
        height = F.when(inside, F.col("_free") * F.col("_free") / 2).otherwise(bound * F.col("_free") - bound * bound / 2)
        sums = at.agg(
            F.sum(n * height).alias("h"),
            *[F.sum(n * rate * p[i]).alias(f"t{i}") for i in range(k)],
            *[F.sum(F.when(inside, n * p[i] * p[j]).otherwise(0.0)).alias(f"m{i}_{j}") for i, j in pairs],
        ).first()
        value = sums["h"] / tokens + sum(m * m / (2 * LENGTH) + a * m for m, a in zip(move, aims, strict=True))
        slope = [m / LENGTH + a - sums[f"t{i}"] / tokens for i, (m, a) in enumerate(zip(move, aims, strict=True))]
        bend = [[sums[f"m{min(i, j)}_{max(i, j)}"] / tokens + (i == j) / LENGTH for j in range(k)] for i in range(k)]
        return value, slope, bend

    passes, missed = 0, math.inf
    while True:
        move = [0.0] * k
        value, slope, bend = landed(move)
        passes += 1
        before = math.hypot(*slope) * tokens / size
        if before <= TOLERANCE or missed - before <= GAIN or passes >= PASSES:
            return now, before
        missed = before
        while math.hypot(*slope) > 1e-3 * TOLERANCE * size / tokens and passes < PASSES:
            step = _solve(bend, [-x for x in slope])
            down, scale = sum(x * y for x, y in zip(slope, step, strict=True)), 1.0
            while passes < PASSES:
                there = [m + scale * x for m, x in zip(move, step, strict=True)]
                found = landed(there)
                passes += 1
                if found[0] <= value + 1e-4 * scale * down + 1e-13 * abs(value) or scale < 1e-9:
                    break
                scale /= 2
            if found[0] >= value and math.hypot(*found[1]) >= math.hypot(*slope):
                break  # as near as doubles come
            move, (value, slope, bend) = there, found
        now = materialise(now.withColumn("rate", F.greatest(bound, free(move))), "rates")


def mix(
    docs: DataFrame,
    labelled: DataFrame,
    weights: Mapping[str, float],
    *,
    id_col: str = "doc_id",
    text: str = "text",
    domain: str = "domain",
    keep: Sequence[str] = (),
    out: str = "mixing",
    seed: int = 17,
) -> DataFrame:
    """``docs`` with a struct ``out``: ``tokens`` (words), ``posterior`` by domain, ``rate``, ``copies`` and ``misfit``.

    ``misfit`` is the same in all rows: by how much the fitted totals miss the targets, as a share of them.

    ``weights`` gives the share of tokens each domain should have; a domain that no label
    names gets nothing.  Documents whose likeliest domain is in ``keep`` have a rate of 1 at
    least, and the whole is sized so that their domains can meet their share at rate 1.
    ``copies`` is the rate rounded at random by the id and text, so its mean is the rate.

    Null and empty texts have no tokens: their rate moves nothing and stays as their prior
    makes it.  Repeated rows are rated alike; with no labels at all every rate is 1.  An
    empty table stays empty; columns may have any name but ``out``.
    """
    if out in docs.columns:
        raise ValueError(f"{out} is already a column")
    model = train(docs, labelled, id_col=id_col, text=text, domain=domain)
    domains = model.domains
    inner = [f"c{i}" for i in range(len(docs.columns))]
    key, body = inner[docs.columns.index(id_col)], inner[docs.columns.index(text)]
    rows = docs.toDF(*inner)
    tokens = F.size(words_of(F.col(body))).cast("long")
    roll = F.pmod(F.xxhash64(F.lit(seed), F.col(key), F.col(body)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    misfit = 0.0
    if not domains:
        rated = rows.select(*inner, tokens.alias("tokens"), F.array().cast("array<double>").alias("posterior"), F.lit(1.0).alias("rate"), roll.alias("_roll"))
    else:
        soft = rows.select(*inner, tokens.alias("tokens"), model.evidence(F.col(body)).alias("_evidence"), roll.alias("_roll"))
        soft = soft.withColumn("posterior", model.posterior(F.col("_evidence"))).drop("_evidence")
        top = F.array_position("posterior", F.array_max("posterior"))
        held = F.coalesce(F.element_at(_numbers([1.0 if d in keep else 0.0 for d in domains]), top.cast("int")), F.lit(0.0))
        soft = soft.withColumn("_least", held)
        soft = materialise(soft, "soft")
        k = len(domains)
        totals = soft.agg(*[F.sum(F.col("tokens") * F.get("posterior", F.lit(i))).alias(f"t{i}") for i in range(k)]).first()
        have = [totals[i] or 0.0 for i in range(k)]
        share = [max(0.0, float(weights.get(d, 0.0))) for d in domains]
        share = [x / (sum(share) or 1.0) for x in share]
        kept = [i for i, d in enumerate(domains) if d in keep and share[i] > 0]
        size = max((have[i] / share[i] for i in kept), default=sum(have))
        rated, misfit = fit_rates(soft, [size * x for x in share], least="_least")
    copies = (F.floor("rate") + (F.col("_roll") < F.col("rate") - F.floor("rate")).cast("long")).cast("long")
    labels = F.lit(domains) if domains else F.array().cast("array<string>")
    result = rated.select(
        *inner,
        F.struct("tokens", F.map_from_arrays(labels, F.col("posterior")).alias("posterior"), "rate", copies.alias("copies"), F.lit(misfit).alias("misfit")).alias("_out"),
    )
    return result.toDF(*docs.columns, out)


def realise(mixed: DataFrame, out: str = "mixing") -> DataFrame:
    """The rows of ``mixed`` as often as ``copies`` says, without ``out``; none for 0 copies."""
    times = F.expr(f"sequence(1L, `{out}`.copies)")
    repeated = mixed.where(F.col(f"`{out}`.copies") > 0).withColumn(out, F.explode(times))
    return repeated.drop(out)


def label_domains(labels: DataFrame) -> DataFrame:
    """``doc_id`` and ``domain`` (toxic, poor or clean) from the labels of quality and toxicity."""
    return labels.select(
        "doc_id",
        F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "poor").when(F.col("quality") == 1, "clean").alias("domain"),
    )
