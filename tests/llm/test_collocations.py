"""Phrase collocations against a plain count of all phrases."""

import re
from collections import Counter

import pytest
from brute import lower_ascii

from shelfcast.llm import collocations


def plain(rows, least, top):
    """(lang, rank, phrase, a, l, r, n, score) from counts of every phrase of up to five words."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\\x0A-\\x0D]", lower_ascii(text or "")):
            w = re.findall("[^\\x20\\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 6):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    found = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    gone = set()
    for (lang, p), a in found.items():
        for i in range(len(p)):
            for j in range(i + 2, len(p) + 1):
                if j - i < len(p) and found[lang, p[i:j]] <= a:
                    gone.add((lang, p[i:j]))
    scored = {}
    for (lang, p), a in found.items():
        if (lang, p) not in gone:
            cuts = [(1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            scored.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return {
        (lang, rank, p.decode(), -a, l, r, n[lang], -score)
        for lang, best in scored.items()
        for rank, (score, a, p, l, r) in enumerate(sorted(best)[:top], 1)
    }


ROWS = [
    ("en", "New York is big. new york city; NEW york City hall, new york city hall is here"),
    ("en", "new york city hall was\tin new york\x0bcity and new york city hall is it"),
    ("en", "a a a a a a a a. a a a"),
    ("en", "one two three four five six seven. one two three four five six seven"),
    ("en", "one two three four five six seven. one two three four five six"),
    (None, "a b a b a b a b. É b É b é b"),
    (None, None),
    ("de", ""),
    ("de", " .,;:!? \n"),
    ("fr", "une seule fois"),
    ("es", "él y él y él y z\U0001f600 y z￿ y z\U0001f600 y z￿ y z\U0001f600 z￿"),
]


@pytest.mark.parametrize("broadcast_rows", [1_000_000, 0])
@pytest.mark.parametrize("least,top", [(2, 2000), (3, 4)])
def test_phrases_are_those_of_a_plain_count(spark, least, top, broadcast_rows):
    rows = ROWS + ROWS[:2]  # repeated rows count again
    docs = spark.createDataFrame([(*r, i, "x", 1) for i, r in enumerate(rows)], "lang string, text string, id long, l string, phrase int")
    got = collocations.collocations(docs, least=least, top=top, broadcast_rows=broadcast_rows)
    assert {tuple(r) for r in got.collect()} == plain(rows, least, top)


def test_a_long_text_and_an_empty_table(spark):
    rows = [("en", " ".join(f"w{i * i % 977}" for i in range(60_000))), ("en", "x" * 1_000_000), ("en", "key=a& " * 100_000)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert {tuple(r) for r in collocations.collocations(docs, least=50).collect()} == plain(rows, 50, 2000)
    assert collocations.collocations(docs.limit(0)).isEmpty()


def test_scores_are_exact_beyond_64_bits(spark):
    big = spark.sql("SELECT 9000000000001L a, 8000000000000007L n, 9000000000003L l, 9000000000005L r")
    over = collocations._whole("a") * collocations._whole("n") * 1000
    got = big.withColumn("_over", over).withColumn("_under", collocations._whole("l") * collocations._whole("r"))
    assert got.selectExpr("_over div _under AS s").first().s == 1000 * 9000000000001 * 8000000000000007 // (9000000000003 * 9000000000005)


def test_merge_joins_move_no_occurrences(spark):
    docs = spark.createDataFrame([("en", "a b c d a b c d")] * 20, "lang string, text string").withColumn("row", collocations.F.monotonically_increasing_id())
    occurrences = docs.repartition(4, "row").select("row", collocations.F.posexplode(collocations.F.split("text", " ")).alias("pos", "w"))
    relation = collocations._Relation(occurrences.selectExpr("row", "pos", "xxhash64(w) AS id"), 4)
    with collocations._merge_joins(spark):
        joined = collocations._further(relation.read(), relation.read())
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert joined.count() == 20 * 7
    assert "SortMergeJoin" in plan and "Exchange" not in plan and plan.count("Sort [") <= 1, plan
    relation.drop()
