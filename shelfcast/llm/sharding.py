"""Sharding by a Feistel permutation of global row numbers.

Rows get the numbers 0 .. n-1 in an order that only depends on their values; a keyed
Feistel network, walked along its cycle until it lands below n, permutes the numbers.
The permuted number gives shard and slot by division, so both can be computed for any
row number without reading the data, and the same rows are always dealt the same way.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.session import materialise

# Order classes of the row numbers.  Fixed, so that numbers don't depend on the cluster;
# it is also the bound on the rows of the offsets table that is broadcast.
CLASSES = 10_000
# Rows of one value that are expanded by one task at a time.
CHUNK = 100_000
ROUNDS = 6
# Prime modulus of the round function: squares of 31-bit numbers fit a long.
_PRIME = 2_147_483_647
WALK = 200


def round_keys(seed: int, rounds: int = ROUNDS) -> list[tuple[int, int]]:
    """Multiplier and addend of each round, from ``seed`` by a linear congruence."""
    keys, x = [], seed % _PRIME
    for _ in range(rounds):
        pair = []
        for _ in range(2):
            x = (x * 48_271 + 11) % _PRIME
            pair.append(x or 1)
        keys.append(tuple(pair))
    return keys


def _bits(n: int) -> tuple[int, int]:
    """Bits of the left and right half for numbers below ``n``; the domain is under 2n (or 4)."""
    total = max(2, (max(n, 1) - 1).bit_length())
    return total // 2, total - total // 2


def permute_number(x: int, n: int, seed: int, rounds: int = ROUNDS) -> int:
    """The permuted place of row number ``x`` among ``n``: the same law in plain Python."""
    left_bits, right_bits = _bits(n)
    keys = round_keys(seed, rounds)
    while True:
        left, right = x >> right_bits, x & ((1 << right_bits) - 1)
        for i, (a, b) in enumerate(keys):
            if i % 2:
                t = (left * a + b) % _PRIME
                right ^= (t * t % _PRIME) & ((1 << right_bits) - 1)
            else:
                t = (right * a + b) % _PRIME
                left ^= (t * t % _PRIME) & ((1 << left_bits) - 1)
        x = (left << right_bits) | right
        if x < n:
            return x


def _step(x: Column, n: int, keys: Sequence[tuple[int, int]]) -> Column:
    """One pass of the network over a long column below the domain's size."""
    left_bits, right_bits = _bits(n)
    if right_bits > 31:
        raise ValueError("row numbers of more than 62 bits")

    state = F.struct(
        F.shiftright(x, right_bits).alias("l"), x.bitwiseAND(F.lit((1 << right_bits) - 1).cast("long")).alias("r")
    )
    # The rounds run over an array so that each half is computed once, not copied into the next.
    table = F.array(*[F.struct(F.lit(i % 2).alias("odd"), F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")) for i, (a, b) in enumerate(keys)])

    def turn(s: Column, k: Column) -> Column:
        source = F.when(k["odd"] == 1, s["l"]).otherwise(s["r"])
        t = F.pmod(source * k["a"] + k["b"], F.lit(_PRIME).cast("long"))
        v = F.pmod(t * t, F.lit(_PRIME).cast("long"))
        return F.struct(
            F.when(k["odd"] == 1, s["l"]).otherwise(s["l"].bitwiseXOR(v.bitwiseAND(F.lit((1 << left_bits) - 1).cast("long")))).alias("l"),
            F.when(k["odd"] == 1, s["r"].bitwiseXOR(v.bitwiseAND(F.lit((1 << right_bits) - 1).cast("long")))).otherwise(s["r"]).alias("r"),
        )

    return F.aggregate(table, state, turn, lambda s: F.shiftleft(s["l"], right_bits).bitwiseOR(s["r"]))


def permuted(x: Column, n: int, seed: int, rounds: int = ROUNDS) -> Column:
    """The permuted number of a long column ``x`` in ``[0, n)``.

    Less than half of the domain lies at or above ``n``, so ``WALK`` steps are passed with
    a chance below 2**-WALK; should a walk be longer, the query raises.
    """
    keys = round_keys(seed, rounds)
    top = F.lit(max(n, 1)).cast("long")

    def walk(y: Column) -> Column:
        more = F.aggregate(
            F.sequence(F.lit(1), F.lit(WALK)), y, lambda z, _: F.when(z < top, z).otherwise(_step(z, n, keys))
        )
        return F.when(y < top, y).otherwise(more)

    # One-element arrays give a value a name, so that it is computed once.
    once = F.transform(F.array(_step(x.cast("long"), n, keys)), walk)
    return F.transform(
        once, lambda y: F.when(y < top, y).otherwise(F.raise_error(F.lit("cycle walk too long")).cast("long"))
    )[0]


def number_rows(rows: DataFrame, number: str = "row_number") -> tuple[DataFrame, int]:
    """``rows`` with a gapless long ``number`` from 0, and the count of rows.

    Equal rows travel as one row with a count until they are numbered, so a value that
    holds a third of the table neither shuffles nor sorts as such.  The order is by hash
    class and then by the values, nulls first: it needs no single task and is the same for
    the same rows, however they are partitioned.  One long (the count) reaches the driver.
    """
    cols = rows.columns
    inner = [f"c{i}" for i in range(len(cols))]
    kinds = rows.toDF(*inner)
    once = kinds.groupBy(*inner).agg(F.count(F.lit(1)).alias("_copies"))
    once = once.withColumn("_class", F.pmod(F.xxhash64(*inner), F.lit(CLASSES)).cast("int"))
    once = materialise(once, "numbered")
    per_class = once.groupBy("_class").agg(F.sum("_copies").alias("_rows"))
    # CLASSES rows at most, whatever the input: one small window task, and safe to broadcast.
    upto = Window.orderBy("_class").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = per_class.withColumn("_before", F.sum("_rows").over(upto) - F.col("_rows"))
    total = per_class.agg(F.sum("_rows")).first()[0] or 0
    inside = Window.partitionBy("_class").orderBy(*inner)
    first = F.sum("_copies").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_copies")
    placed = once.select("*", first.alias("_first")).join(F.broadcast(offsets.select("_class", "_before")), "_class")
    start = (F.col("_before") + F.col("_first")).alias("_start")
    single = placed.where("_copies = 1").select(*inner, start.alias("_number"))
    # Copies come back in chunks, each dealt to a task of its own.
    many = (
        placed.where("_copies > 1")
        .select(*inner, "_copies", start, F.explode(F.expr(f"sequence(0L, _copies - 1, {CHUNK}L)")).alias("_from"))
        .repartition(F.col("_start"), F.col("_from"))
        .select(
            *inner,
            F.explode(F.expr(f"sequence(_start + _from, _start + least(_from + {CHUNK}L, _copies) - 1)")).alias("_number"),
        )
    )
    return single.unionByName(many).toDF(*cols, number), int(total)


def deal(rows: DataFrame, *, shards: int = 16, seed: int = 20_240_229) -> DataFrame:
    """``rows`` with ``row_number``, ``place`` (its permuted number), ``shard`` and ``slot``.

    Law: rows.  Shard sizes differ by one at most and slots are gapless from 0 in each
    shard.  All columns may be null or repeat; equal rows and equal texts get numbers of
    their own and are dealt apart.  An empty table stays empty.  The four names must not be columns of ``rows``.
    """
    if shards < 1:
        raise ValueError("at least one shard")
    clash = {"row_number", "place", "shard", "slot"} & set(rows.columns)
    if clash:
        raise ValueError(f"already columns: {sorted(clash)}")
    numbered, n = number_rows(rows)
    placed = numbered.withColumn("place", permuted(F.col("row_number"), n, seed))
    return placed.select(
        "*",
        F.pmod(F.col("place"), F.lit(shards).cast("long")).cast("int").alias("shard"),
        F.expr(f"place div {shards}L").alias("slot"),
    )


def digest(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Id, size (UTF-8 bytes and one) and unsigned CRC-32 of each text; null counts as empty."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(body) + F.lit(1)).cast("long").alias("size"),
        F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"),
    )


def write_shards(dealt: DataFrame, path: str) -> None:
    """Write dealt rows as one folder per shard; its files follow the order of the slots."""
    dealt.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
