"""Language profiles against a plain sum of n-gram vectors, and held-out accuracy."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfcast.llm import language_id
from shelfcast.llm.language_id import SIZE, Profiles, _space

DOCS = "/root/testdata/sf0.01/documents.parquet"


def plain_vector(text):
    """The sum of the vectors of a text's n-grams, letter by letter; None without a letter."""
    letters = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " "
    while "  " in letters:
        letters = letters.replace("  ", " ")
    if letters == " ":
        return None
    space, total = _space(SIZE, 0), np.zeros(SIZE)
    code = lambda c: 0 if c == " " else ord(c)
    for gram, n in Counter(letters[i : i + 3] for i in range(len(letters) - 2)).items():
        a, b, c = (space.letter(code(x)) for x in gram)
        total += float(n) * np.roll(a, 2) * np.roll(b, 1) * c
    return total


def plain_fit(rows):
    sums = {}
    for lang, text in rows:
        v = plain_vector(text) if lang is not None and text is not None else None
        if v is not None:
            sums[lang] = sums.get(lang, 0) + v / np.linalg.norm(v)
    return {k: v / np.linalg.norm(v) for k, v in sums.items()}


TEXTS = ["The house, the sea; THE king's", "das Haus und die See", "une école à la mer", "", " 123 !?", None, "a", "\U0001f600 x", "ΣΑΣ ǅ ß"]
ROWS = [("en", TEXTS[0]), ("en", "it was the old house of the king"), ("de", TEXTS[1]), ("de", "der König ist nicht da"), ("fr", TEXTS[2]), (None, "nothing"), ("xx", None), ("yy", "12")]


@pytest.fixture(scope="module")
def profiles(spark):
    return language_id.fit(spark.createDataFrame(ROWS + ROWS[:1], "lang string, text string"))


def test_profiles_are_near_plain_bundles(profiles):
    want = plain_fit(ROWS + ROWS[:1])
    assert profiles.names == sorted(want)
    # Texts are weighted by the length of their counts, which nearly is that of their vectors.
    assert all(profiles.vectors[i] @ want[n] > 0.99 for i, n in enumerate(profiles.names))


def test_scores_are_the_cosines_of_plain_vectors(spark, profiles):
    docs = spark.createDataFrame([(i, t, 1, "l", 2) for i, t in enumerate(TEXTS + TEXTS[:2])], "doc_id int, text string, score int, lang string, _out int")
    said = language_id.identify(docs, profiles)
    assert said.columns == [*docs.columns, "language"]
    for r in said.collect():
        v = plain_vector(r.text) if r.text is not None else None
        if v is None:
            assert (r.language.lang, r.language.score) == ("und", 0.0)
        else:
            cosines = profiles.vectors @ v / np.linalg.norm(v)
            assert r.language.lang == profiles.names[int(cosines.argmax())]
            assert r.language.score == pytest.approx(max(0.0, cosines.max()), abs=1e-9)


def test_ties_nothing_learned_and_empty_tables(spark, profiles):
    docs = spark.createDataFrame([(1, "abc"), (2, None)], "doc_id int, text string")
    one = profiles.vectors[0]
    twins = Profiles(["b", "c"], np.stack([one, one]))
    assert {r.language.lang for r in language_id.identify(docs, twins).collect()} == {"b", "und"}
    nothing = language_id.fit(docs.limit(0).withColumn("lang", F.lit("en")))
    assert nothing.names == [] and {r.language for r in language_id.identify(docs, nothing).collect()} == {("und", 0.0)}
    assert language_id.identify(docs.limit(0), profiles).isEmpty()


def test_long_texts_are_counted_whole(spark, profiles):
    space = _space(SIZE, 0)
    text = "".join(f"wort{chr(97 + i % 26)}{chr(97 + i * 7 % 26)}, " for i in range(150_000))
    codes, times = space.count(text)
    v = sum(n * g.astype(float) for n, g in zip(times, space.grams(codes)))
    assert np.array_equal(v, plain_vector(text))
    docs = spark.createDataFrame([(1, text), (2, "x" * 1_000_000), (3, "<a " * 300_000)], "doc_id int, text string")
    assert all(0 <= r.language.score <= 1 and r.language.lang in profiles.names for r in language_id.identify(docs, profiles).collect())


def test_held_out_documents_and_order(spark):
    docs = spark.read.parquet(DOCS)
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    profiles = language_id.fit(docs.where(~held))
    again = language_id.fit(docs.where(~held).repartition(7).sortWithinPartitions(F.desc("doc_id")))
    assert np.array_equal(profiles.vectors, again.vectors)
    said = language_id.identify(docs.where(held), profiles)
    right = said.agg(F.avg((F.col("language.lang") == F.col("lang")).cast("int")).alias("x")).first().x
    assert right >= 0.98


def test_too_many_languages_raise(spark, monkeypatch):
    monkeypatch.setattr(language_id, "MOST_LANGUAGES", 2)
    with pytest.raises(ValueError):
        language_id.fit(spark.createDataFrame(ROWS, "lang string, text string"))
