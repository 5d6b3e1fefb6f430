"""Line dedup: three-line windows that occur more than once are cut but for the first time.

Each window of consecutive lines becomes 128 bits of hash, counted over the whole corpus.
Of a window found again, every occurrence but the first is removed: the positions that such
occurrences cover are merged per document and the lines there dropped.  Texts don't take
part in the counting; they meet the covered positions in one join on the row's number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.session import materialise


def _windows(lines: Column, width: int) -> Column:
    """Array of (position, two hashes) for the windows that hold a word."""
    marked = F.transform(
        lines,
        lambda s: F.struct(F.xxhash64(s).alias("x"), F.xxhash64(F.lit(1), s).alias("y"), s.rlike("[^\\x20\\x09-\\x0D]").alias("w")),
    )

    def cut(m: Column) -> Column:
        many = F.greatest(F.size(m) - (width - 1), F.lit(0))
        zipped = F.arrays_zip(*[F.slice(m, F.lit(k + 1), many).alias(f"l{k}") for k in range(width)])
        rows = F.transform(
            zipped,
            lambda z, i: F.struct(
                i.alias("at"),
                F.xxhash64(*[z[f"l{k}"]["x"] for k in range(width)]).alias("h1"),
                F.xxhash64(*[z[f"l{k}"]["y"] for k in range(width)]).alias("h2"),
                F.greatest(*[z[f"l{k}"]["w"] for k in range(width)]).alias("w"),
            ),
        )
        return F.filter(rows, lambda r: r["w"])

    # One-element arrays name a value, so that it is computed once.
    return F.transform(F.array(marked), cut)[0]


def dedup_lines(
    docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", width: int = 3, out: str = "line_dedup"
) -> DataFrame:
    """``docs`` with repeated passages cut from ``text`` and a struct ``out`` of
    ``n_lines`` and ``removed`` (positions of the dropped lines, ascending).

    Lines are the parts between ``\\n``, compared as they are; windows of blank lines don't
    count.  The first occurrence is the one with the smallest id (nulls first), then text
    hash, row and position; equal rows are told apart by their row, so the later of two
    equal rows loses its windows.  Texts of fewer than ``width`` lines, empty ones included,
    stay as they are, and null stays null.  Repeats inside one text count too; of windows
    that overlap their own copy (A A A A) the first line stays.  An empty table gives an
    empty table; other columns pass through under any name but ``out``.
    """
    if out in docs.columns:
        raise ValueError(f"{out} is already a column")
    inner = [f"c{i}" for i in range(len(docs.columns))]
    key, body = inner[docs.columns.index(id_col)], inner[docs.columns.index(text)]
    # Written once: the row numbers must be the same in the counting and in the final join.
    rows = materialise(docs.toDF(*inner).withColumn("_row", F.monotonically_increasing_id()), "lines")
    found = rows.select(
        F.col("_row"),
        F.col(key).alias("_id"),
        F.xxhash64(body).alias("_text"),
        F.inline(_windows(F.split(body, "\n"), width)),
    ).drop("w")
    found = materialise(found, "line-windows")
    place = F.struct("_id", "_text", "_row", "at")
    # Counted with map-side combine; a window in a third of all documents leaves each task as one row.
    first = found.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("_n"), F.min(place).alias("_first")).where("_n > 1")
    later = (
        found.join(first, ["h1", "h2"])
        .where((F.col("_row") != F.col("_first._row")) | (F.col("at") != F.col("_first.at")))
        .groupBy("_row")
        .agg(F.collect_set("at").alias("_starts"))  # bounded by the lines of one text
    )
    covered = F.sort_array(F.array_distinct(F.flatten(F.transform("_starts", lambda s: F.sequence(s, s + (width - 1))))))
    later = later.select("_row", covered.alias("_gone"))
    joined = rows.join(later, "_row", "left").withColumn("_lines", F.split(body, "\n"))
    n = F.coalesce(F.size("_lines"), F.lit(0))
    n = F.when(F.col(body).isNull(), F.lit(0)).otherwise(n)
    stay = F.when(
        F.col("_gone").isNotNull(),
        F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_gone")),
    )
    joined = joined.select(*inner, "_lines", "_gone", n.alias("_n"), stay.alias("_stay"))
    kept_text = F.array_join(F.transform("_stay", lambda i: F.get(F.col("_lines"), i)), "\n")
    result = joined.select(
        *[F.when(F.col("_gone").isNull(), F.col(c)).otherwise(kept_text).alias(c) if c == body else F.col(c) for c in inner],
        F.struct(
            F.col("_n").alias("n_lines"), F.coalesce(F.col("_gone"), F.array().cast("array<int>")).alias("removed")
        ).alias("_out"),
    )
    return result.toDF(*docs.columns, out)
