"""The transfer state machine on a stream of actions (W3) and the alert sink."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from shelfcast.operators.exchange import FIRST_STATE, STEPS, TRANSITIONS
from shelfcast.operators.inventory import alerts

# Of a shard: the transfers that have moved, their states and when (watermark, ms) they last did; the waiting actions.
STATE = (
    "moved array<string>, state array<string>, seen array<bigint>, "
    "at array<bigint>, id array<bigint>, action array<string>, transfer array<string>"
)
SHARDS = 1024
_DAY_MS = 86_400_000
_LAST_ID = 2**63 - 1


def _advance(
    key: tuple, batches: Iterator[pd.DataFrame], memory: GroupState, keep_days: int | None = None
) -> Iterator[pd.DataFrame]:
    """Hold the actions of a shard until the watermark has passed them, then apply them in time order."""
    moved, states, seen, *held = memory.get if memory.exists else [[] for _ in range(7)]
    state_of, seen_at = dict(zip(moved, states)), dict(zip(moved, seen))
    waiting = list(zip(*held))
    for batch in batches:
        waiting += zip(*[batch[c].tolist() for c in ("at_us", "event_id", "action", "transfer_id")])
    now = memory.getCurrentWatermarkMs()
    waiting.sort(key=lambda w: w[:3])
    ready = [w for w in waiting if w[0] <= now * 1000]
    waiting = waiting[len(ready) :]
    for _, _, action, transfer in ready:
        state = state_of.get(transfer, FIRST_STATE)
        state = TRANSITIONS.get((state, action), state)
        if state != FIRST_STATE:
            state_of[transfer], seen_at[transfer] = state, now
    timers = [-(-waiting[0][0] // 1000) - 1] if waiting else []
    if keep_days is not None:
        kept = 1 + keep_days * _DAY_MS
        busy = {w[3] for w in waiting}
        seen_at = {t: at for t, at in seen_at.items() if t in busy or at + kept >= now}
        idle = [at + kept for t, at in seen_at.items() if t not in busy]
        timers += [min(idle)] if idle else []
    if seen_at or waiting:
        columns = [list(c) for c in zip(*waiting)] or [[], [], [], []]
        memory.update((list(seen_at), [state_of[t] for t in seen_at], list(seen_at.values()), *columns))
        if timers:
            # Due once the watermark is beyond it.
            memory.setTimeoutTimestamp(max(min(timers), now + 1))
    elif memory.exists:
        memory.remove()
    if ready:
        touched = list(dict.fromkeys(w[3] for w in ready))
        yield pd.DataFrame({"transfer_id": touched, "state": [state_of.get(t, FIRST_STATE) for t in touched]})


def transfer_states(
    actions: DataFrame, *, delay: str = "1 day", keep_days: int | None = None, shards: int = SHARDS
) -> DataFrame:
    """``(transfer_id, state)`` whenever a transfer has moved on; run in update mode.

    Only the three actions that can move a transfer are kept, and of these only the
    ones inside the watermark's delay wait in state, so the state of a transfer is
    bounded by its actions of that time span, not by its history: a word once none waits, nothing before
    its first step.  It is kept, as the next action depends on it however late it comes.  Where ids never
    return, ``keep_days`` of event time without actions may end it.

    Transfers share a state by the hash of their id, as a call of Python for each of them costs far
    more than its actions.  A batch rewrites the states of the ``shards`` it touches: take more for very many
    transfers, with the RocksDB store (``spark.sql.streaming.stateStore.providerClass``).  Their number stays
    as it is as long as the checkpoint lives.
    Of actions at the same time those without an ``event_id`` come last; the watermark never passes one without a time.
    """
    steps = [a for a, _ in STEPS]
    return (
        actions.where(F.col("action").isin(*steps) & F.col("ts").isNotNull())
        .withWatermark("ts", delay)
        .select(
            F.pmod(F.xxhash64("transfer_id"), F.lit(shards)).cast("int").alias("shard"),
            "transfer_id",
            "ts",
            F.coalesce("event_id", F.lit(_LAST_ID)).alias("event_id"),
            "action",
            F.unix_micros("ts").alias("at_us"),
        )
        .groupBy("shard")
        .applyInPandasWithState(
            partial(_advance, keep_days=keep_days), "transfer_id string, state string", STATE, "update", GroupStateTimeout.EventTimeTimeout
        )
    )


def write_alerts(decisions: DataFrame, path: str, checkpoint: str):
    """Append the alerts of every batch of decisions to a table.

    Each batch has its own folder, so a batch repeated after a failure is written
    once.  Returns the started query builder's running query.
    """

    def append(batch: DataFrame, number: int) -> None:
        alerts(batch).write.mode("overwrite").parquet(f"{path}/_batch={number}")

    return (
        decisions.writeStream.foreachBatch(append)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
