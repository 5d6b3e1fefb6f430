"""The anomaly rules with history on a stream of daily rows (W2 with A4, A6, A10, A12).

Each series keeps a ring of its last rows in state; a row waits until the watermark has passed it,
is then measured against the ring in the order of dates, and is judged by the same rules as the batch
scan, as plain columns.  The fence comes from a static table of bounds, as one row per series.

The state store has to be RocksDB (``spark.sql.streaming.stateStore.providerClass``); what it holds
of a series is the ring, and the rows of the watermark's delay.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from shelfcast.functions.keys import SERIES
from shelfcast.functions.numeric import ratio
from shelfcast.operators.anomaly import AnomalyRules, context_factor, flag, rule_flags

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_ROW = "at bigint, sales double, price double, current_stock bigint, is_promotion int"
_RING = "sales array<double>, price double, current_stock bigint, at bigint"
_OUT = ", ".join(
    [f"{c} string" for c in SERIES] + [_ROW, "_mean double", "_std double", "_price_before double", "_stock_before bigint"]
)
_DAY_MS = 86_400_000


def _known(value):
    """None for what pandas shows as missing."""
    return None if value is None or value != value else value


class _Measure(StatefulProcessor):
    def __init__(self, window: int, keep_days: int | None):
        self.window, self.keep_days = window, keep_days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ring = handle.getValueState("ring", _RING)
        self.waiting = handle.getListState("waiting", _ROW)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [
            (int(r.at), _known(r.sales), _known(r.price), _known(r.current_stock), _known(r.is_promotion))
            for frame in rows
            for r in frame.itertuples(index=False)
        ]
        yield from self._move_on(key, new, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._move_on(key, [], timerValues)

    def _move_on(self, key, new: list[tuple], timerValues) -> Iterator[pd.DataFrame]:
        """Measure what the watermark has passed; the rest waits for a timer."""
        mark = timerValues.getCurrentWatermarkInMs()
        rows = sorted([tuple(w) for w in self.waiting.get()] + new, key=lambda r: r[0])
        ready = [r for r in rows if r[0] <= mark]
        rest = rows[len(ready) :]
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.waiting.put(rest) if rest else self.waiting.clear()
        if ready:
            yield self._measured(key, ready)
        if rest:
            self.handle.registerTimer(max(rest[0][0] + 1, mark + 1))
        elif not new and not ready:
            self.ring.clear()  # whatever comes now is too late to use it
        elif self.keep_days is not None:
            self.handle.registerTimer(mark + 1 + self.keep_days * _DAY_MS)

    def _measured(self, key, ready: list[tuple]) -> pd.DataFrame:
        held = self.ring.get() if self.ring.exists() else ([], None, None, None)
        sales, price, stock, last = [_known(x) for x in held[0]], _known(held[1]), _known(held[2]), held[3]
        out = []
        for row in ready:
            if self.keep_days is not None and last is not None and row[0] - last > self.keep_days * _DAY_MS:
                sales, price, stock = [], None, None
            last = row[0]
            sales = [*sales, row[1]][-self.window :]
            there = [x for x in sales if x is not None]
            mean = sum(there) / len(there) if there else None
            spread = math.sqrt(sum((x - mean) ** 2 for x in there) / (len(there) - 1)) if len(there) > 1 else 1.0
            out.append((*key, *row, mean, spread, price, stock))
            price, stock = row[2], row[3]
        self.ring.update((sales, price, stock, last))
        frame = pd.DataFrame(out, columns=[f.split()[0] for f in _OUT.split(", ")])
        return frame.astype({"current_stock": "Int64", "is_promotion": "Int32", "_stock_before": "Int64"})

    def close(self) -> None:
        pass


def measured(rows: DataFrame, rules: AnomalyRules = AnomalyRules(), *, delay: str = "2 days", keep_days: int | None = None) -> DataFrame:
    """Rows (series, ``ts``, ``sales, price, current_stock, is_promotion``) with the measures of A4 and the values before.

    One row per series and time; rows later than ``delay`` are dropped.  A row more than ``keep_days`` after the one
    before it (never, if None) has no history; series idle for so long leave the state.
    """
    kept = rows.withWatermark("ts", delay).select(
        *[F.col(c).cast("string").alias(c) for c in SERIES],
        "ts",
        F.unix_millis("ts").alias("at"),
        F.col("sales").cast("double").alias("sales"),
        F.col("price").cast("double").alias("price"),
        F.col("current_stock").cast("bigint").alias("current_stock"),
        F.col("is_promotion").cast("int").alias("is_promotion"),
    )
    return kept.groupBy(*SERIES).transformWithStateInPandas(
        statefulProcessor=_Measure(rules.rolling_window, keep_days), outputStructType=_OUT, outputMode="Append", timeMode="EventTime"
    )


def history_flags(rows: DataFrame, bounds: DataFrame, rules: AnomalyRules = AnomalyRules(), *, delay: str = "2 days", keep_days: int | None = None) -> DataFrame:
    """All rules of the batch scan on a stream: ``(series, date, sales, anomaly_type, anomaly_severity, anomaly_score, anomaly_reason)``.

    ``bounds`` holds ``(series, base_upper)``; a series without one has no spikes by fence.  Rows without a finding
    come out as NORMAL.
    """
    seen = measured(rows, rules, delay=delay, keep_days=keep_days)
    seen = seen.withColumn("date", F.timestamp_millis("at").cast("date")).withColumn("day_of_week", F.weekday("date"))
    seen = seen.join(bounds.select(*SERIES, "base_upper"), SERIES, "left")
    seen = seen.withColumn("_bound", F.col("base_upper") * context_factor(seen.columns, rules))
    seen = seen.withColumn("_z", F.abs(ratio(F.col("sales") - F.col("_mean"), F.col("_std"))))
    verdict = None
    for condition, finding in rule_flags(seen.columns, rules):
        verdict = F.when(condition, finding) if verdict is None else verdict.when(condition, finding)
    found = seen.withColumn("_flag", verdict.otherwise(flag("NORMAL", "NONE", 0.0, "")))
    return found.select(
        *SERIES,
        "date",
        "sales",
        F.col("_flag.type").alias("anomaly_type"),
        F.col("_flag.severity").alias("anomaly_severity"),
        F.col("_flag.score").alias("anomaly_score"),
        F.col("_flag.reason").alias("anomaly_reason"),
    )
