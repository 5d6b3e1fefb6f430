"""Rows a user may see."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The role and the entry that open every store.
ALL_STORES_ROLE = "ADMIN"
ANY_STORE = "*"


def granted_stores(users: DataFrame) -> DataFrame:
    """``(user, stores)``: the user's store list; ``*`` stands for all."""
    listed = F.transform(F.split("authorized_stores", ","), lambda s: F.trim(s))
    return users.select(
        "user", F.when(F.col("role") == ALL_STORES_ROLE, F.array(F.lit(ANY_STORE))).otherwise(listed).alias("stores")
    )


def restrict(rows: DataFrame, users: DataFrame, user: str) -> DataFrame:
    """The rows of one user's stores; nothing for an unknown user or one without stores.

    The list is one field of one user, so it enters the filter as a value and the
    rows are read once, without a join.  A user with several rows has the union of their stores.
    """
    mine = granted_stores(users.where(F.col("user") == user)).agg(F.array_distinct(F.flatten(F.collect_list("stores")))).scalar()
    allowed = F.array_contains(mine, F.lit(ANY_STORE)) | F.array_contains(mine, F.col("store_id"))
    return rows.where(F.coalesce(allowed, F.lit(False)))
