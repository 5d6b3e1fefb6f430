"""Operators that judge, number, cut or code single rows: literal cases and plain versions."""

import re
from collections import Counter

import pytest
from brute import WORD
from pyspark.sql import functions as F

from shelfcast.llm import line_dedup, piece_coding, quality_rules, sharding
from shelfcast.llm.piece_coding import SPACE, Coder

SMALL = "/root/testdata/sf0.001/documents.parquet"
LONG = " ".join(f"word{i % 613}" for i in range(40_000))


# --- quality rules ---------------------------------------------------------------------------


def plain_measures(text):
    text = text or ""
    w = WORD.findall(text)
    tri = Counter(zip(w, w[1:], w[2:]))
    covered = set()
    for i in range(len(w) - 2):
        if tri[tuple(w[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered))


def test_measures_are_those_of_a_plain_loop(spark):
    texts = [None, "", " \t\n", "one", "a b c a b c", "x x x x x x", "é ü # $|<> %", "l 1\nl 1\n\n\nl 1 \nl 1", LONG, "a\x0bb\x0cc\rd"]
    texts += [r[0] for r in spark.read.parquet(SMALL).select("text").limit(60).collect()]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    got = {r.doc_id: tuple(r.quality[n] for n in names) for r in quality_rules.judge(docs).collect()}
    assert got == {i: plain_measures(t) for i, t in enumerate(texts)}


def test_rules_reject_junk_and_keep_prose(spark):
    prose = "The house of the king is by the sea and it was old. " + " ".join(f"the part{i} of it is number{i * 7}" for i in range(20))
    junk = [" ".join(f"w{i}%%%" for i in range(80)), " ".join(f"LOUD{chr(65 + i % 26)}{chr(65 + i // 26)}!!" for i in range(80)), "again and again " * 40, "too short"]
    docs = spark.createDataFrame([(0, prose, "a", 1), *[(i + 1, t, "b", 2) for i, t in enumerate(junk)], (9, None, None, None)], "doc_id long, text string, _w string, _m int")
    assert [r.doc_id for r in quality_rules.keep_good(docs).collect()] == [0]
    assert quality_rules.keep_good(docs).columns == docs.columns
    assert quality_rules.judge(docs.limit(0)).isEmpty()
    table = (quality_rules.Rule("short", "word_length", least=100.0),)
    assert quality_rules.judge(docs, rules=table).where("doc_id = 0").first().quality.broken == ["short"]
    plan = quality_rules.judge(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


# --- sharding --------------------------------------------------------------------------------


def test_feistel_is_a_permutation_and_the_same_in_spark_and_python(spark):
    for n in (1, 2, 3, 5, 16, 17, 1000, 4097):
        want = [sharding.permute_number(x, n, 9) for x in range(n)]
        assert sorted(want) == list(range(n))
        got = [r[0] for r in spark.range(n).orderBy("id").select(sharding.permuted(F.col("id"), n, 9)).collect()]
        assert got == want


def test_rows_are_dealt_evenly_and_the_same_for_any_partitioning(spark):
    docs = spark.createDataFrame([(i % 700, "t" * (i % 5)) if i > 400 else (None, None) for i in range(1000)], "doc_id long, text string")
    dealt = [sorted(map(tuple, sharding.deal(sharding.digest(docs.repartition(p))).collect()), key=str) for p in (1, 5)]
    assert dealt[0] == dealt[1]
    rows = dealt[0]
    assert sorted(r[3] for r in rows) == list(range(1000))
    sizes = Counter(r[5] for r in rows)
    assert len(sizes) == 16 and max(sizes.values()) - min(sizes.values()) <= 1
    for shard, n in sizes.items():
        assert sorted(r[6] for r in rows if r[5] == shard) == list(range(n))
    assert all(r[4] == sharding.permute_number(r[3], 1000, 20_240_229) and (r[5], r[6]) == (r[4] % 16, r[4] // 16) for r in rows)
    assert sharding.deal(sharding.digest(docs.limit(0))).isEmpty()
    with pytest.raises(ValueError):
        sharding.deal(docs.withColumn("slot", F.lit(1)))


def test_written_shards_follow_their_slots(spark, tmp_path):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    sharding.write_shards(sharding.deal(docs, shards=4), f"{tmp_path}/out")
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.count() == 300 and {tuple(r) for r in back.groupBy("shard").count().collect()} == {(i, 75) for i in range(4)}


# --- line dedup ------------------------------------------------------------------------------


def plain_dedup(rows):
    seen, out = set(), []
    for key, text in rows:
        if text is None:
            out.append((key, None, []))
            continue
        lines, gone = text.split("\n"), set()
        for i in range(len(lines) - 2):
            w = tuple(lines[i : i + 3])
            if any(WORD.search(x) for x in w):
                if w in seen:
                    gone |= {i, i + 1, i + 2}
                seen.add(w)
        out.append((key, "\n".join(x for i, x in enumerate(lines) if i not in gone), sorted(gone)))
    return out


def test_lines_removed_are_those_of_a_plain_loop(spark):
    rows = [(1, "a\nb\nc\nd"), (2, "x\na\nb\nc\nd\ny"), (3, "a\na\na\na\na"), (4, None), (5, ""), (6, "\n\n\n\n\n"), (7, "a\nb"), (8, "b\nc\nd\n\n\n"),
            (9, "\n".join(f"line {i % 900}" for i in range(20_000))), (10, "a\nb\nc\nd")]
    rows += [(100 + r[0], r[1]) for r in spark.read.parquet(SMALL).orderBy("doc_id").select("doc_id", "text").collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id, r.text, r.line_dedup.removed) for r in line_dedup.dedup_lines(docs).collect())
    assert got == plain_dedup(rows)


def test_equal_rows_keep_one_copy_and_columns_pass(spark):
    docs = spark.createDataFrame([(1, "a\nb\nc", 5, "p"), (1, "a\nb\nc", 6, "q"), (None, "a\nb\nc", 7, "r")], "doc_id long, text string, _row int, at string")
    cut = line_dedup.dedup_lines(docs)
    assert cut.columns == [*docs.columns, "line_dedup"]
    assert sorted(r.text for r in cut.collect()) == ["", "", "a\nb\nc"] and cut.where("doc_id IS NULL").first().text == "a\nb\nc"
    assert line_dedup.dedup_lines(docs.limit(0)).isEmpty()


# --- piece coding ----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def vocabulary():
    return piece_coding.load_vocabulary()


def plain_best(coder, text):
    """Score of the best segmentation by dynamic programming over all pieces."""
    v = coder.vocabulary
    pieces = {p: v.scores[i] for i, p in enumerate(v.pieces) if i not in v.special}
    best = [0.0]
    for e in range(1, len(text) + 1):
        b = best[e - 1] + coder.byte_score * len(text[e - 1].encode())
        for s in range(max(0, e - 16), e):
            if text[s:e] in pieces:
                b = max(b, best[s] + pieces[text[s:e]])
        best.append(b)
    return best[-1]


def test_segmentations_are_the_best_ones(vocabulary):
    coder = Coder(vocabulary)
    byte = set(vocabulary.bytes_)
    for text in ("Hello world, thorea!", "  deux  espaces", "naïve 東京 😀 mot", "a.b.c idiot### of%%%", "x" * 40):
        ids = coder.encode(text)
        got = sum(coder.byte_score if i in byte else vocabulary.scores[i] for i in ids)
        assert abs(got - plain_best(coder, (" " + text).replace(" ", SPACE))) < 1e-6


def test_texts_come_back(spark, vocabulary):
    texts = ["", " ", "\n", "a", SPACE, f"a{SPACE}{SPACE}b {SPACE}", "<0x0A> <s></s>", "tab\there\x00nul", "  ", "é é", "😀" * 50, LONG, " lead", "trail "]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, None), (3, "a")], "doc_id long, text string")
    coded = piece_coding.encode_texts(docs, vocabulary)
    rows = coded.collect()
    assert len(rows) == len(texts) + 2 and all(r.exact for r in rows)
    assert {r.doc_id: r.ids for r in rows}[None] is None and {r.doc_id: r.ids for r in rows}[0] == []
    back = {r.doc_id: r.text for r in piece_coding.decode_ids(coded, vocabulary).collect()}
    assert back == {**dict(enumerate(texts)), None: None}
    assert piece_coding.encode_texts(docs.limit(0), vocabulary).isEmpty()
    table = piece_coding.encode_texts(spark.read.parquet(SMALL), vocabulary)
    assert table.where("NOT exact OR n_tokens <> size(ids)").isEmpty()


def test_parts_are_cut_only_where_no_piece_goes_across(vocabulary):
    coder = Coder(vocabulary)
    whole = Coder(vocabulary)
    whole.parts = re.compile("(?s).+")
    for text in ("one, two;three!four", "La casa. de|papel #5 $x", "line\nbreak\n\nend"):
        a, b = coder.encode(text), whole.encode(text)
        score = lambda ids: sum(coder.byte_score if i in set(vocabulary.bytes_) else vocabulary.scores[i] for i in ids)
        assert abs(score(a) - score(b)) < 1e-6
