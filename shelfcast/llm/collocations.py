"""Phrase collocations by set-oriented relational mining (SETM).

The occurrences of every frequent phrase of k words are a relation (document, position,
phrase number), written in buckets of documents and sorted by document and position.  The
occurrences of phrases of k + 1 words are that relation merge-joined with itself one position
further, their groups are counted, and only occurrences of frequent groups are written for the
next length.  All of a document lies in one bucket, so the merge joins shuffle nothing; what
moves is the counts, combined in each task first.

A phrase of k + 1 words is named by its first k and its last k words, so groups are pairs of
numbers and exact; texts of phrases are put together once, for the frequent ones.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfcast.functions.skew import skew_join
from shelfcast.session import ensure_checkpoint_dir, materialise

#: A phrase counts as frequent from this many occurrences of its language on.
LEAST = 100

#: Words of the longest phrases.
LONGEST = 5

#: Frequent groups up to this many are sent to every task (some 100 MB in memory at most);
#: more are joined by their key, and the occurrences go back to their documents.
BROADCAST_ROWS = 1_000_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _tokens(text):
    """Words in order; each run of piece ends is a token of its own, a line feed."""
    lowered = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    return F.split(F.regexp_replace(lowered, "[.,;:!?\\x0A-\\x0D]+", " \n "), "[\\x20\\x09]+")


@contextmanager
def _merge_joins(spark: SparkSession) -> Iterator[None]:
    """Joins on (document, position) take buckets of documents as they lie, sorted as they are."""
    wanted = {
        "spark.sql.requireAllClusterKeysForCoPartition": "false",
        "spark.sql.legacy.bucketedTableScan.outputOrdering": "true",
    }
    before = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


class _Relation:
    """A written relation of occurrences (row, pos, id) in sorted buckets of rows."""

    def __init__(self, occurrences: DataFrame, parts: int):
        self.spark = occurrences.sparkSession
        self.name = f"occurrences_{uuid.uuid4().hex}"
        self.path = f"{ensure_checkpoint_dir(self.spark).rstrip('/')}/{self.name}"
        writer = occurrences.write.bucketBy(parts, "row").sortBy("row", "pos").option("path", self.path)
        writer.format("parquet").saveAsTable(self.name)

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def _of_frequent(occurrences: DataFrame, frequent: DataFrame, keys: list[str], parts: int, most: int) -> DataFrame:
    """(row, pos, id) of the occurrences whose group is in ``frequent (*keys, id)``."""
    lookup = frequent.select(*keys, "id")
    if frequent.count() <= most:
        return occurrences.join(F.broadcast(lookup), keys).select("row", "pos", "id")
    joined = skew_join(occurrences, lookup, keys, spread=["row", "pos"])
    return joined.select("row", "pos", "id").repartition(parts, "row")


def _further(left: DataFrame, right: DataFrame) -> DataFrame:
    """Phrases one word longer: (row, pos, l, r) where r occurs one position after l."""
    a = left.select("row", "pos", F.col("id").alias("l"), (F.col("pos") + 1).alias("_at"))
    b = right.select(F.col("row").alias("_row"), F.col("pos").alias("_pos"), F.col("id").alias("r"))
    return a.hint("merge").join(b, (a["row"] == b["_row"]) & (a["_at"] == b["_pos"])).select("row", "pos", "l", "r")


def mine(
    docs: DataFrame,
    *,
    text: str = "text",
    lang: str = "lang",
    least: int = LEAST,
    longest: int = LONGEST,
    broadcast_rows: int = BROADCAST_ROWS,
) -> tuple[list[DataFrame], DataFrame]:
    """Frequent phrases by length (``[words, pairs, ...]``) and ``(lang, n)``, all words of each language.

    Every frame has id, lang, phrase, f, and for each phrase the occurrences of its beginnings
    (``pre``) and ends (``suf``) of 1, 2, ... words, and the numbers ``l`` and ``r`` of its
    first and last words in the frame before (null for single words).

    Letters A-Z are lowered; pieces end at ``[.,;:!?]``, line feeds and the like; words are what
    blanks and tabs separate.  Null and empty texts have no words, a null language is ``und``;
    repeated rows count as often as they occur.  An empty table gives empty frames.  Other
    columns of ``docs`` are not read, whatever their names.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    is_word = (F.col("word") != "") & (F.col("word") != "\n")
    tally = (
        texts.select("lang", F.explode(_tokens(F.col("text"))).alias("word"))
        .where(is_word)
        .groupBy("lang", "word")
        .agg(F.count(F.lit(1)).alias("f"))
    )
    tally = materialise(tally, "words")
    sizes = materialise(tally.groupBy("lang").agg(F.sum("f").alias("n")), "language-sizes")
    numbered = tally.where(F.col("f") >= least).withColumn("id", F.monotonically_increasing_id())
    none = F.array().cast("array<bigint>")
    frequent = materialise(numbered, "phrases-1")
    found = [
        frequent.select(
            "id", "lang", F.col("word").alias("phrase"), "f", none.alias("pre"), none.alias("suf"), F.col("word").alias("last"),
            F.lit(None).cast("bigint").alias("l"), F.lit(None).cast("bigint").alias("r"),
        )
    ]
    placed = (
        texts.withColumn("row", F.monotonically_increasing_id())
        .repartition(parts, "row")  # whole texts move once; their words are together from here on
        .select("row", "lang", F.posexplode(_tokens(F.col("text"))).alias("pos", "word"))
        .where(is_word)
    )
    with _merge_joins(spark):
        relation = _Relation(_of_frequent(placed, frequent, ["lang", "word"], parts, broadcast_rows), parts)
        for k in range(2, longest + 1):
            longer = _further(relation.read(), relation.read())
            counted = longer.groupBy("l", "r").agg(F.count(F.lit(1)).alias("f")).where(F.col("f") >= least)
            frequent = materialise(counted.withColumn("id", F.monotonically_increasing_id()), f"phrases-{k}")
            found.append(_named(frequent, found[-1], k))
            if k < longest:
                following = _Relation(_of_frequent(longer, frequent, ["l", "r"], parts, broadcast_rows), parts)
                relation.drop()
                relation = following
        relation.drop()
    return found, sizes


def _named(frequent: DataFrame, shorter: DataFrame, k: int) -> DataFrame:
    """Texts and counts of parts for phrases given by the numbers of their first and last words."""
    first = shorter.select(
        F.col("id").alias("l"), "lang", F.col("phrase").alias("_head"), F.concat("pre", F.array("f")).alias("pre")
    )
    rest = shorter.select(F.col("id").alias("r"), F.col("last"), F.concat("suf", F.array("f")).alias("suf"))
    named = frequent.join(first, "l").join(rest, "r")
    phrase = F.concat_ws(" ", "_head", "last").alias("phrase")
    return materialise(named.select("id", "lang", phrase, "f", "pre", "suf", "last", "l", "r"), f"named-{k}")


def _whole(c: str):
    """Exact whole numbers beyond 64 bits."""
    return F.col(c).cast("decimal(19,0)")


def collocations(
    docs: DataFrame, *, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, top: int = 2000,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """The best ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    ``a`` counts the phrase; cut after its first words, its parts occur ``l`` and ``r`` times, and
    the cut with the least ``floor(1000 * a * n / (l * r))`` gives the score, ties to the earliest
    cut.  A phrase goes if a phrase one word longer that holds it occurs as often: counts never
    grow with length, so a holder of any length that occurs as often implies one of these.
    Ties of the ranking go by a (most first) and phrase (UTF-8 order).  Inputs as in ``mine``.
    """
    found, sizes = mine(docs, text=text, lang=lang, least=least, longest=longest, broadcast_rows=broadcast_rows)
    kept = []
    for k in range(2, longest + 1):
        phrases = found[k - 1]
        if k < longest:
            longer = found[k].select("l", "r", "f", "pre", "suf")
            # The last entry of pre counts the first k words, that of suf the last k.
            heads = longer.where(F.col("f") >= F.element_at("pre", -1)).select(F.col("l").alias("id"))
            tails = longer.where(F.col("f") >= F.element_at("suf", -1)).select(F.col("r").alias("id"))
            phrases = phrases.join(heads.union(tails).distinct(), "id", "left_anti")
        kept.append(phrases.select("lang", "phrase", F.col("f").alias("a"), "pre", "suf"))
    phrases = kept[0]
    for more in kept[1:]:
        phrases = phrases.union(more)
    cuts = F.zip_with("pre", F.reverse("suf"), lambda l, r: F.struct(l.alias("l"), r.alias("r")))
    cuts = phrases.join(sizes, "lang").select("lang", "phrase", "a", "n", F.posexplode(cuts).alias("k", "cut"))
    cuts = cuts.select("lang", "phrase", "a", "n", "k", "cut.l", "cut.r")
    scored = cuts.withColumn("_over", _whole("a") * _whole("n") * F.lit(1000).cast("decimal(4,0)"))
    scored = scored.withColumn("_under", _whole("l") * _whole("r")).withColumn("score", F.expr("_over div _under"))
    best = F.min(F.struct("score", "k", "l", "r")).alias("_best")
    scored = scored.groupBy("lang", "phrase", "a", "n").agg(best).select("lang", "phrase", "a", "n", "_best.*")
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
