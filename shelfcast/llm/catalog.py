"""The registered queries of the corpus operators and, where SQL can say it, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.catalog import Entry
from shelfcast.llm import (
    collocations,
    conversation_repair,
    html_template,
    jaccard_join,
    language_id,
    line_dedup,
    mixing,
    neighbours,
    piece_coding,
    quality_rules,
    secret_scan,
    sharding,
    toxicity,
)
from shelfcast.llm.tables import table
from shelfcast.session import materialise


def quality(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, folder, "documents"))
    q = F.col("quality")
    return judged.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        *[q[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")],
    )


_STOP = ", ".join(f"'{w}'" for w in quality_rules.STOP_WORDS)
_LIMIT = {r.name: r for r in quality_rules.RULES}

#: Words and lines of every text, and what is counted over them.
QUALITY_SQL = f"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda s: regexp_matches(s, '[^\\x20\\x09-\\x0D]')) AS l
  FROM documents),
words AS (SELECT doc_id, unnest(w) AS w, unnest(range(len(w))) AS i FROM t),
win AS (
  SELECT doc_id, i, w AS a, lead(w, 1) OVER p AS b, lead(w, 2) OVER p AS c
  FROM words WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
again AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM win WHERE c IS NOT NULL)
  WHERE n > 1),
rep AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM again, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
m AS (
  SELECT t.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         length(text) - length(replace(text, '!', '')) AS ex,
         len(l) AS lines, len(l) - len(list_distinct(l)) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words,
         len(list_filter(w, lambda x: list_contains([{_STOP}], lower(x)))) AS stop,
         len(list_filter(w, lambda x: length(x) > 1 AND upper(x) = x AND lower(x) <> x)) AS cap
  FROM t LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, n_words < 50 OR n_repeat_words * 100 > n_words * 50 AS base_failed FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
       CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed
         AND word_chars / n_words BETWEEN {_LIMIT['mean_word_length'].least} AND {_LIMIT['mean_word_length'].most}
         AND n_symbols / n_words <= {_LIMIT['symbols_per_word'].most}
         AND ex / n_words <= {_LIMIT['exclamations_per_word'].most}
         AND cap / n_words <= {_LIMIT['capital_words'].most}
         AND stop / n_words >= {_LIMIT['stop_words'].least}
         AND n_dup_lines / lines <= {_LIMIT['repeated_lines'].most} AS kept
FROM b"""


def shards(spark: SparkSession, folder: str) -> DataFrame:
    dealt = sharding.deal(sharding.digest(table(spark, folder, "documents")), shards=16)
    return dealt.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def lines(spark: SparkSession, folder: str) -> DataFrame:
    cut = line_dedup.dedup_lines(table(spark, folder, "documents"))
    return cut.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("line_dedup.n_lines").cast("long").alias("n_lines"),
        F.size("line_dedup.removed").cast("long").alias("n_removed"),
        F.length("text").cast("long").alias("kept_chars"),
        F.md5(F.encode("text", "UTF-8")).alias("kept_md5"),
    )


LINES_SQL = """
WITH t AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
lines AS (SELECT doc_id, unnest(l) AS s, unnest(range(len(l))) AS i, len(l) AS n FROM t),
win AS (
  SELECT doc_id, i, n, s AS a, lead(s, 1) OVER p AS b, lead(s, 2) OVER p AS c
  FROM lines WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
later AS (
  SELECT doc_id, i FROM (
    SELECT doc_id, i, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, i) AS k
    FROM win WHERE i + 2 < n AND regexp_matches(a || b || c, '[^\\x20\\x09-\\x0D]'))
  WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM later, (SELECT unnest([0, 1, 2]) AS k)),
kept AS (
  SELECT lines.doc_id, string_agg(s, chr(10) ORDER BY lines.i) AS text, count(*) AS stay
  FROM lines LEFT JOIN gone ON gone.doc_id = lines.doc_id AND gone.i = lines.i
  WHERE gone.i IS NULL GROUP BY lines.doc_id)
SELECT t.doc_id, CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - coalesce(stay, 0) AS BIGINT) AS n_removed,
       CAST(length(coalesce(kept.text, '')) AS BIGINT) AS kept_chars, md5(coalesce(kept.text, '')) AS kept_md5
FROM t LEFT JOIN kept USING (doc_id)"""


def alike(spark: SparkSession, folder: str) -> DataFrame:
    groups = jaccard_join.JaccardJoin(table(spark, folder, "documents"), words=4, percent=85).groups()
    return groups.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id")


def mixture(spark: SparkSession, folder: str) -> DataFrame:
    labels = mixing.label_domains(table(spark, folder, "labels"))
    mixed = mixing.mix(table(spark, folder, "documents"), labels, {"clean": 0.9, "poor": 0.06, "toxic": 0.04})
    return mixed.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "mixing.tokens",
        *[F.col(f"mixing.posterior.{d}").alias(f"p_{d}") for d in ("clean", "poor", "toxic")],
        "mixing.rate",
        "mixing.copies",
    )


def near_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.nearest(table(spark, folder, "embeddings"), queries=lambda i: i % 50 == 0, k=5)


def secrets(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = secret_scan.candidates(docs, secret_scan.language(docs), path="source")
    found = materialise(found, "candidates")
    judged = secret_scan.judge(found, secret_scan.rule_labels(found))
    return judged.select(
        "doc_id", "start", F.length("finding").cast("long").alias("length"), F.round("score", 6).alias("score"), "is_secret"
    )


def toxic(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    third = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    model = toxicity.fit(docs, table(spark, folder, "labels").where(~third))
    return toxicity.scored(docs, model).select("doc_id", third.alias("held_out"), "score", "predicted")


def main_texts(spark: SparkSession, folder: str) -> DataFrame:
    texts = html_template.extract(table(spark, folder, "pages"))
    return texts.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def pieces(spark: SparkSession, folder: str) -> DataFrame:
    return piece_coding.encode_texts(table(spark, folder, "documents"), piece_coding.load_vocabulary())


def conversations(spark: SparkSession, folder: str) -> DataFrame:
    damaged = conversation_repair.damage(table(spark, folder, "conversations"))
    return conversation_repair.digest_of_damaged(damaged)


def languages(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    fourth = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    profiles = language_id.fit(docs.where(~fourth))
    said = language_id.identify(docs, profiles)
    return said.select(
        "doc_id", fourth.alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score")
    )


def phrases(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(table(spark, folder, "documents"))


PHRASES_SQL = f"""
WITH doc AS (
  SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang,
         regexp_split_to_array(regexp_replace(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[.,;:!?\\x0A-\\x0D]+', ' ' || chr(10) || ' ', 'g'), '[\\x20\\x09]+') AS t
  FROM documents),
word AS (
  SELECT * FROM (SELECT d, lang, unnest(t) AS w, generate_subscripts(t, 1) AS i FROM doc) WHERE w NOT IN ('', chr(10))),
near AS (
  SELECT lang, i, w AS w1, lead(w, 1) OVER p AS w2, lead(w, 2) OVER p AS w3, lead(w, 3) OVER p AS w4, lead(w, 4) OVER p AS w5,
         lead(i, 1) OVER p AS i2, lead(i, 2) OVER p AS i3, lead(i, 3) OVER p AS i4, lead(i, 4) OVER p AS i5
  FROM word WINDOW p AS (PARTITION BY d ORDER BY i)),
f AS (
  SELECT lang, phrase, count(*) AS f FROM (
    SELECT lang, w1 AS phrase FROM near
    UNION ALL SELECT lang, concat_ws(' ', w1, w2) FROM near WHERE i2 = i + 1
    UNION ALL SELECT lang, concat_ws(' ', w1, w2, w3) FROM near WHERE i3 = i + 2
    UNION ALL SELECT lang, concat_ws(' ', w1, w2, w3, w4) FROM near WHERE i4 = i + 3
    UNION ALL SELECT lang, concat_ws(' ', w1, w2, w3, w4, w5) FROM near WHERE i5 = i + 4)
  GROUP BY lang, phrase),
n AS (SELECT lang, count(*) AS n FROM word GROUP BY lang),
cand AS (
  SELECT lang, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE f >= {collocations.LEAST} AND phrase LIKE '% %'),
part AS (SELECT lang, ws, a, unnest(range(1, len(ws))) AS s FROM cand),
span AS (SELECT lang, ws, a, s, unnest(range(s + 1, len(ws) + 1)) AS e FROM part),
held AS (
  SELECT lang, array_to_string(ws[s:e], ' ') AS phrase, max(a) AS a FROM span WHERE e - s + 1 < len(ws) GROUP BY ALL),
cut AS (
  SELECT c.lang, c.phrase, c.a, c.ws, unnest(range(1, len(c.ws))) AS k
  FROM cand c LEFT JOIN held h ON h.lang = c.lang AND h.phrase = c.phrase WHERE h.a IS NULL OR h.a < c.a),
scored AS (
  SELECT cut.lang, cut.phrase, cut.a, k, x.f AS l, y.f AS r, n.n,
         (CAST(1000 AS HUGEINT) * cut.a * n.n) // (CAST(x.f AS HUGEINT) * y.f) AS score
  FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = array_to_string(ws[1:k], ' ')
  JOIN f y ON y.lang = cut.lang AND y.phrase = array_to_string(ws[k + 1:], ' ') JOIN n ON n.lang = cut.lang),
best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n,
       CAST(score AS BIGINT) AS score
FROM best QUALIFY rank <= 2000"""


ENTRIES = {
    "op4_neighbours": Entry(near_vectors),
    "op5_secret_scan": Entry(secrets),
    "op6_toxicity": Entry(toxic),
    "op8_html_template": Entry(main_texts),
    "op9_piece_coding": Entry(pieces),
    "op1_mixing": Entry(mixture),
    "op2_line_dedup": Entry(lines, LINES_SQL),
    "op3_jaccard_join": Entry(alike),
    "op7_quality_rules": Entry(quality, QUALITY_SQL),
    "op10_sharding": Entry(shards),
    "op11_conversation_repair": Entry(conversations),
    "op12_language_id": Entry(languages),
    "op13_collocations": Entry(phrases, PHRASES_SQL),
}
