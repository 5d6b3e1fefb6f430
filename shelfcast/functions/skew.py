"""Joining on keys of which a few may hold a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hot_keys(rows: DataFrame, keys: Sequence[str], *, shares: int = 1000) -> DataFrame:
    """Keys holding more than ``1/shares`` of all rows, and ``_fan``, the partitions each fills.

    There can be at most ``shares`` of them, whatever the data: that is the size
    bound that makes broadcasting the result safe.  A key with half of the rows fills half
    of the shuffle partitions, so no part of it is larger than an even partition.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tally = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    everything = tally.agg(F.sum("_rows")).scalar()
    fan = F.greatest(F.lit(2), F.ceil(F.col("_rows") * F.lit(parts) / everything)).cast("int")
    return tally.where(F.col("_rows") * F.lit(shares) > everything).select(*keys, fan.alias("_fan"))


def skew_join(
    rows: DataFrame,
    lookup: DataFrame,
    keys: Sequence[str],
    *,
    spread: Sequence[str],
    how: str = "inner",
    shares: int = 1000,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Equi-join in which hot keys of ``rows`` are spread in proportion to their share.

    ``spread`` names columns that tell the rows of one key apart (an id); the salt
    is a hash of them, so a retried task salts its rows the same way.  Only the
    lookup rows of hot keys are repeated, ``_fan`` times each.  ``hot`` takes the
    result of ``hot_keys`` where several joins share it.
    """
    keys = list(keys)
    hot = hot_keys(rows, keys, shares=shares) if hot is None else hot
    hot = F.broadcast(hot)
    salted = (
        rows.join(hot, keys, "left")
        .withColumn(
            "_salt",
            F.when(F.col("_fan").isNotNull(), F.pmod(F.xxhash64(*spread), F.col("_fan")).cast("int")).otherwise(F.lit(0)),
        )
        .drop("_fan")
    )
    repeated = (
        lookup.join(hot, keys, "left")
        .withColumn(
            "_salt",
            F.explode(F.when(F.col("_fan").isNotNull(), F.sequence(F.lit(0), F.col("_fan") - 1)).otherwise(F.array(F.lit(0)))),
        )
        .drop("_fan")
    )
    return salted.join(repeated, [*keys, "_salt"], how).drop("_salt")


def all_pairs_of(left: DataFrame, right: DataFrame, right_key: str, *, slots: int | None = None) -> DataFrame:
    """Every combination of two key lists, built as an equi-join.

    The left list is repeated once per slot and each right key belongs to one
    slot, so the combinations are produced in ``slots`` independent parts (as many
    as there are shuffle partitions).
    """
    slots = slots or int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = left.withColumn("_slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
    right = right.withColumn("_slot", F.pmod(F.xxhash64(right_key), F.lit(slots)).cast("int"))
    return left.join(right, "_slot").drop("_slot")
