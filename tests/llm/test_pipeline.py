"""Every stage of the pipeline by itself, and all of them in turn, over documents with what can go wrong added."""

import pytest
from brute import jaccard_groups
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from shelfcast.llm import quality_rules

FOLDER = "/root/testdata/sf0.001"
EXTRA = ["_cut", "quality", "number", "mixing", "_row", "c0"]


@pytest.fixture(scope="module")
def docs(spark):
    """The given documents, repeated rows, null and empty texts, a null row, and columns whose names the stages use themselves."""
    given = spark.read.parquet(f"{FOLDER}/documents.parquet")
    odd = spark.createDataFrame([(10**9, None, None, None, None), (10**9 + 1, "", "en", "x", 0), (10**9 + 2, " \n\t", "de", "y", 3), (None, "a b", None, None, 3)], given.schema)
    rows = given.union(given.where("doc_id % 20 = 0")).union(odd)
    return rows.select("*", *[F.lit(i).alias(c) for i, c in enumerate(EXTRA)])


@pytest.mark.parametrize("name,stage", pipeline.STAGES)
def test_an_empty_table_stays_empty(spark, docs, name, stage):
    out = stage(spark, docs.limit(0), FOLDER)
    assert out.isEmpty()
    if name != "piece coding":
        assert out.columns == docs.columns


def test_quality_rules_keep_what_they_judge_good(spark, docs):
    kept = pipeline.good_documents(spark, docs, FOLDER)
    assert kept.columns == docs.columns
    judged = quality_rules.judge(docs, out="verdict").where("verdict.kept").drop("verdict")
    assert sorted(map(str, kept.collect())) == sorted(map(str, judged.collect()))
    assert kept.where("text IS NULL OR trim(text) = ''").isEmpty()


def test_line_dedup_leaves_no_window_twice_and_no_empty_text(spark, docs):
    cut = pipeline.without_repeats(spark, docs.where("text IS NOT NULL"), FOLDER)
    assert cut.columns == docs.columns
    seen = set()
    for r in cut.collect():
        lines = r.text.split("\n")
        for i in range(len(lines) - 2):
            window = tuple(lines[i : i + 3])
            if any(line.strip(" \t\n\x0b\x0c\r") for line in window):
                assert window not in seen or any(lines[j : j + 3] == list(window) for j in range(max(0, i - 2), i)), window
                seen.add(window)
    # Texts that lost nothing keep their row as it is, null and empty ones included.
    untouched = pipeline.without_repeats(spark, docs.where("doc_id >= 1000000000"), FOLDER)
    assert sorted(map(str, untouched.collect())) == sorted(map(str, docs.where("doc_id >= 1000000000").collect()))


def test_one_document_of_each_group_stays(spark, docs):
    kept = pipeline.one_of_each(spark, docs, FOLDER)
    assert kept.columns == docs.columns
    rows = [(i, r.text) for i, r in enumerate(docs.collect())]
    groups = jaccard_groups(rows, 5, 80)
    with_words = {g[2] for g in groups if g[1] > 0}
    without = sum(g[1] == 0 for g in groups)
    assert kept.count() == len(with_words) + without


def test_mixing_keeps_clean_documents_and_codes_give_texts_back(spark, docs):
    mixed = pipeline.mixed(spark, docs, FOLDER)
    assert mixed.columns == docs.columns
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").where("quality = 1 AND toxic = 0").select("doc_id")
    before, after = (d.join(labels, "doc_id", "left_semi").select("doc_id").distinct().count() for d in (docs, mixed))
    assert after >= 0.97 * before
    coded = pipeline.encoded(spark, docs, FOLDER)
    assert coded.count() == docs.count()


def test_all_stages_in_turn(spark):
    out = pipeline.run(spark, FOLDER)
    given = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert 0 < out.count() and out.join(given, "doc_id", "left_anti").isEmpty()
    good = pipeline.good_documents(spark, given, FOLDER)
    one = pipeline.one_of_each(spark, pipeline.without_repeats(spark, good, FOLDER), FOLDER)
    assert out.select("doc_id").distinct().count() <= one.count()
