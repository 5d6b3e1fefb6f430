import random
from collections import Counter

from brute import jaccard_groups
from pyspark.sql import functions as F

from shelfcast.llm.jaccard_join import JaccardJoin, keep_one

SMALL = "/root/testdata/sf0.001/documents.parquet"


def rows_of(spark, docs, **how):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    return Counter(tuple(r) for r in JaccardJoin(df, **how).groups().select("id", "n", "component_id").collect())


def copies(seed: int) -> list[tuple]:
    """A base text with near copies at many distances, none of them the base, and boilerplate."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefg") for _ in range(5))
    docs, key = [], 0
    line = " ".join(word() for _ in range(30))
    for _ in range(3):
        base = [word() for _ in range(r.randint(60, 140))]
        for _ in range(25):
            w = list(base)
            for _ in range(r.randint(1, 5)):
                w[r.randrange(len(w))] = word()
            docs.append((key, line + "\n" + " ".join(w)))
            key += r.randint(1, 3)
    for _ in range(30):
        docs.append((key, line + " " + " ".join(word() for _ in range(r.randint(1, 40)))))
        key += 1
    r.shuffle(docs)
    return docs


def test_same_as_all_pairs_on_near_copies(spark):
    for seed in (1, 2):
        docs = copies(seed)
        assert rows_of(spark, docs, words=4, percent=85) == Counter(jaccard_groups(docs, 4, 85))


def test_same_as_all_pairs_on_the_table(spark):
    docs = [tuple(r) for r in spark.read.parquet(SMALL).select("doc_id", "text").collect()]
    assert rows_of(spark, docs, words=5, percent=80) == Counter(jaccard_groups(docs, 5, 80))


def test_nulls_short_texts_ties_and_long_texts(spark):
    long = " ".join(f"w{i % 977}x{i}" for i in range(60_000))
    docs = [(None, "one two three four five"), (5, "One TWO three four five"), (5, "one two three four five"), (6, None), (7, ""), (7, " \n\t "),
            (8, "É two"), (9, "é two"), (10, "a b"), (11, "A  b"), (12, long), (13, long + " end"), (None, None), (None, "lone words here")]
    got = rows_of(spark, docs, words=4, percent=85)
    assert got == Counter(jaccard_groups(docs, 4, 85))
    assert got[(None, 0, None)] == 1 and got[(13, 59_998, 12)] == 1


def test_empty_table_and_clashing_columns(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert JaccardJoin(none).groups().isEmpty() and keep_one(none).isEmpty()
    docs = spark.createDataFrame(
        [(1, "a b c d e f", 9, "x"), (2, "a b c d e f", 8, "y"), (3, None, 7, "z"), (4, "", 6, None), (1, "a b c d e f", 9, "x")],
        "doc_id long, text string, key long, root string",
    )
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 4]


def test_keep_one_keeps_one_of_each_group(spark):
    docs = spark.read.parquet(SMALL)
    want = {c for _, n, c in jaccard_groups([tuple(r) for r in docs.select("doc_id", "text").collect()], 5, 80)}
    kept = keep_one(docs).select("doc_id").collect()
    assert sorted(r[0] for r in kept) == sorted(want)
    assert keep_one(docs).join(docs.select("doc_id", F.col("text").alias("t")), "doc_id").where("text <> t").isEmpty()
