"""Quality rules: a table of thresholds compiled into one projection.

Every measure is a built-in Spark expression over one document, so the operator is a
scan and a projection: no shuffle, no user function, no state.  The rule table is data;
``compile_rules`` turns it into the verdict column and a list of the rules that failed.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.llm.tables import free_name, words_of

# Common function words of the four languages of the corpus.
STOP_WORDS = (
    "the of and to a in is that for it was on as with be by are this at from "
    "der die und den von das zu mit sich des auf für ist nicht im dem eine ein als "
    "de la le et les en un du une que pour est par dans qui pas sur au avec "
    "el y los del se las por su con no una para es al lo"
).split()


@dataclass(frozen=True)
class Rule:
    """``share`` (a measure) must lie in ``[least, most]``; a bound left out doesn't hold."""

    name: str
    share: str
    least: float | None = None
    most: float | None = None


#: Length, symbol, stop-word and line ratios.  The bounds are wide of clean prose.
RULES = (
    Rule("mean_word_length", "word_length", least=2.0, most=14.0),
    Rule("symbols_per_word", "symbol_ratio", most=0.1),
    Rule("exclamations_per_word", "exclaim_ratio", most=0.2),
    Rule("capital_words", "capital_ratio", most=0.4),
    Rule("stop_words", "stop_ratio", least=0.02),
    Rule("repeated_lines", "dup_line_ratio", most=0.5),
)

_SYMBOLS = "[#*$%&|<>]"


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the base counts and the ratios that rules refer to, as one struct ``_m``.

    A null text counts as empty.  ``n_dup_lines`` counts lines that hold a word and equal
    an earlier line; ``n_repeat_words`` counts the words covered by three-word windows
    that occur at least twice in the text (windows are told apart by a 64-bit hash).
    Ratios of a text without words are null and fail no rule: the base rule rejects it.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    cut = docs.select("*", words_of(F.col(text)).alias("_w"), F.split(body, "\n").alias("_l"))
    n = F.size("_w")
    m = F.greatest(n - 2, F.lit(0))
    windows = F.arrays_zip(
        F.slice("_w", F.lit(1), m).alias("a"), F.slice("_w", F.lit(2), m).alias("b"), F.slice("_w", F.lit(3), m).alias("c")
    )
    cut = cut.select(
        "*",
        F.transform(windows, lambda t: F.xxhash64(t["a"], t["b"], t["c"])).alias("_h"),
        F.filter("_l", lambda s: s.rlike("[^\\x20\\x09-\\x0D]")).alias("_full"),
    )
    cut = cut.select("*", (F.size(F.array_distinct("_h")) < F.size("_h")).alias("_again"))
    # Sorted by hash, equal windows are neighbours; texts without any skip the sort.
    placed = F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    cut = cut.select("*", F.when(F.col("_again"), placed).alias("_s"))
    k = F.size("_s") - 1
    pairs = F.zip_with(
        F.slice("_s", F.lit(1), k),
        F.slice("_s", F.lit(2), k),
        lambda x, y: F.when(x["h"] == y["h"], F.array(x["i"], y["i"])).otherwise(F.array().cast("array<int>")),
    )
    cut = cut.select("*", F.when(F.col("_again"), F.sort_array(F.array_distinct(F.flatten(pairs)))).alias("_p"))
    k = F.size("_p") - 1
    gaps = F.zip_with(F.slice("_p", F.lit(1), k), F.slice("_p", F.lit(2), k), lambda x, y: F.least(y - x, F.lit(3)))
    covered = F.when(F.col("_again"), F.aggregate(gaps, F.lit(3), lambda s, g: s + g)).otherwise(F.lit(0))

    stop = F.size(F.filter("_w", lambda w: F.lower(w).isin(STOP_WORDS)))
    capital = F.size(F.filter("_w", lambda w: (F.length(w) > 1) & (F.upper(w) == w) & (F.lower(w) != w)))
    counts = cut.select(
        *docs.columns,
        n.cast("long").alias("_n"),
        F.length(F.array_join("_w", "")).cast("long").alias("_chars"),
        F.regexp_count(body, F.lit(_SYMBOLS)).cast("long").alias("_sym"),
        F.regexp_count(body, F.lit("!")).alias("_ex"),
        F.size("_full").alias("_lines"),
        (F.size("_full") - F.size(F.array_distinct("_full"))).cast("long").alias("_dup"),
        covered.cast("long").alias("_rep"),
        stop.alias("_stop"),
        capital.alias("_cap"),
    )
    per_word = F.when(F.col("_n") > 0, F.col("_n"))
    return counts.select(
        *docs.columns,
        F.struct(
            F.col("_n").alias("n_words"),
            F.col("_chars").alias("word_chars"),
            F.col("_sym").alias("n_symbols"),
            F.col("_dup").alias("n_dup_lines"),
            F.col("_rep").alias("n_repeat_words"),
            (F.col("_chars") / per_word).alias("word_length"),
            (F.col("_sym") / per_word).alias("symbol_ratio"),
            (F.col("_ex") / per_word).alias("exclaim_ratio"),
            (F.col("_cap") / per_word).alias("capital_ratio"),
            (F.col("_stop") / per_word).alias("stop_ratio"),
            (F.col("_dup") / F.when(F.col("_lines") > 0, F.col("_lines"))).alias("dup_line_ratio"),
        ).alias("_m"),
    )


def base_failed(m: Column) -> Column:
    """Fewer than 50 words, or more than half of the words inside repeated windows."""
    return (m["n_words"] < 50) | (m["n_repeat_words"] * 100 > m["n_words"] * 50)


def compile_rules(rules: Sequence[Rule], m: Column) -> Column:
    """The names of the rules that a document breaks, as an array in the order of the table."""
    broken = []
    for r in rules:
        low = m[r.share] < r.least if r.least is not None else F.lit(False)
        high = m[r.share] > r.most if r.most is not None else F.lit(False)
        broken.append(F.when(F.coalesce(low | high, F.lit(False)), F.lit(r.name)))
    return F.array_compact(F.array(*broken)) if broken else F.array().cast("array<string>")


def judge(docs: DataFrame, *, rules: Sequence[Rule] = RULES, text: str = "text", out: str = "quality") -> DataFrame:
    """``docs`` with a struct ``out``: the measures, ``base_failed``, ``broken`` rules and ``kept``.

    Rows are judged one by one, so repeated rows and null ids get their own verdicts; an
    empty table gives an empty table.  Columns of ``docs`` may have any name but ``out``.
    """
    if out in docs.columns:
        raise ValueError(f"{out} is already a column")
    # Plain names while measuring, so that no column of the caller can clash with an inner one.
    kept_names = [f"c{i}" for i in range(len(docs.columns))]
    inner = docs.toDF(*kept_names)
    measured = measure(inner, kept_names[docs.columns.index(text)])
    m = F.col("_m")
    failed = base_failed(m)
    broken = compile_rules(rules, m)
    verdict = m.withField("base_failed", failed).withField("broken", broken).withField("kept", ~failed & (F.size(broken) == 0))
    return measured.select(*kept_names, verdict.alias(out)).toDF(*docs.columns, out)


def keep_good(docs: DataFrame, *, rules: Sequence[Rule] = RULES, text: str = "text") -> DataFrame:
    """The documents that pass, with their columns unchanged."""
    verdict, number = free_name(docs, "quality"), free_name(docs, "number")
    judged = judge(docs, rules=rules, text=text, out=verdict)
    # A filter on a plain column is moved below its projections, with the whole verdict copied
    # into it and worked out anew for every use; one that also reads a row number stays above.
    judged = judged.withColumn(number, F.monotonically_increasing_id())
    return judged.where(F.col(f"{verdict}.kept") & (F.col(number) >= 0)).drop(verdict, number)
