"""Repair of the structure of conversations by cheapest edits.

Edits lead from a conversation's messages to one that is empty, or an optional system message
and then user and assistant in turn: K keeps a message (0), R gives it the role user or
assistant (2), D deletes it (3; blank messages and repeats have to go), I inserts an empty
message of user or assistant (2); a cut-off message that isn't deleted costs 1 more.  Of the
cheapest edits those whose initials come first in ASCII order win.

Nodes of the lattice are (messages read, role said last).  A forward and a reverse heap meet in
it, all crossings of equal cost are finished, and the least concatenation of a forward and a
reverse string of initials is taken.  Strings that lead to one node at one cost never begin with each
other, so the least prefix and the least rest make the least whole.

Messages are sorted by conversation over all tasks; each task cuts its conversations into chunks of
bounded length.  A chunk that holds a whole conversation is solved where it is.  A chunk of a longer one is
solved from every role it may begin after to every role it may end with; the costs, a few numbers a
chunk, are put together per conversation and tell each chunk which of its solutions holds.
Texts are shuffled once, whatever a conversation's share of all messages.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfcast.functions.skew import skew_join
from shelfcast.session import materialise

START, SYSTEM, USER, ASSISTANT = range(4)
"""What was said last."""

CHUNK_ROWS = 512
CHUNK_CHARS = 1 << 20
"""A chunk is closed at this many messages, or characters of them; results don't depend on it."""

_ENDS = (START, ASSISTANT)
_OUT = 5  # ways a chunk ends: after one of four roles with more to come (0-3), or as the last (4)

# Where each role leads, and where a message with the role that is due leads.
_KEEP = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
_DUE = {START: USER, SYSTEM: USER, ASSISTANT: USER, USER: ASSISTANT}
_DUE_BACK = {q: [p for p, to in _DUE.items() if to == q] for q in range(4)}
_KEEP_BACK = {r: {q: [p for p, to in step.items() if to == q] for q in range(4)} for r, step in _KEEP.items()}
_NONE: dict = {}


def _steps(rows, i, q, last):
    """Edits from a node: (initial, cost, messages read, role)."""
    if i < len(rows):
        initial, forced, cut_off = rows[i]
        yield "D", 3, i + 1, q
        if not forced:
            to = _KEEP.get(initial, _NONE).get(q)
            if to is not None:
                yield "K", cut_off, i + 1, to
            yield "R", 2 + cut_off, i + 1, _DUE[q]
    # After a chunk's last message nothing is inserted unless the conversation ends there:
    # the next chunk may do so before its first one.
    if i < len(rows) or last:
        yield "I", 2, i, _DUE[q]


def _steps_back(rows, i, q, last):
    """Edits into a node."""
    if i > 0:
        initial, forced, cut_off = rows[i - 1]
        yield "D", 3, i - 1, q
        if not forced:
            for p in _KEEP_BACK.get(initial, _NONE).get(q, ()):
                yield "K", cut_off, i - 1, p
            for p in _DUE_BACK[q]:
                yield "R", 2 + cut_off, i - 1, p
    if i < len(rows) or last:
        for p in _DUE_BACK[q]:
            yield "I", 2, i, p


class _Side:
    """One of the two searches: labels (cost, initials) of nodes, and the heap of open ones.

    Edits that cost nothing read a message, so nodes leave the heap in the order of cost and
    then of messages read; a label is final when its node leaves.
    """

    def __init__(self, rows, sources, last, back):
        self.rows, self.last, self.back = rows, last, back
        self.labels = {node: (0, "") for node in sources}
        self.done = set()
        self.heap = [(0, self._order(node[0]), node) for node in sources]
        heapq.heapify(self.heap)

    def _order(self, i):
        return -i if self.back else i

    def least(self):
        """The cost of the next node to leave; None if there is none."""
        while self.heap and self.heap[0][2] in self.done:
            heapq.heappop(self.heap)
        return self.heap[0][0] if self.heap else None

    def settle(self):
        """Take the next node and offer its label to its neighbours; returns those."""
        _, _, node = heapq.heappop(self.heap)
        self.done.add(node)
        cost, initials = self.labels[node]
        reached = []
        for edit, price, *to in (_steps_back if self.back else _steps)(self.rows, *node, self.last):
            to = tuple(to)
            label = (cost + price, edit + initials if self.back else initials + edit)
            if to not in self.labels or label < self.labels[to]:
                self.labels[to] = label
                heapq.heappush(self.heap, (label[0], self._order(to[0]), to))
                reached.append(to)
        return reached


def cheapest(rows: list[tuple[str, bool, int]], *, entry: int = START, exits=_ENDS, last: bool = True) -> tuple[int, str] | None:
    """Least cost and, of the edits that cost no more, the least initials; None if no edits lead there.

    ``rows`` has (role's initial, has to go, 1 if cut off) per message.
    """
    ahead = _Side(rows, [(0, entry)], last, False)
    behind = _Side(rows, [(len(rows), q) for q in exits], last, True)
    best = 0 if (0, entry) in behind.labels else None
    while True:
        a, b = ahead.least(), behind.least()
        if a is None or b is None or (best is not None and a + b > best):
            break
        side, other = (ahead, behind) if a <= b else (behind, ahead)
        for node in side.settle():
            if node in other.labels:
                met = side.labels[node][0] + other.labels[node][0]
                best = met if best is None else min(best, met)
    if best is None:
        return None
    crossings = (n for n, (cost, _) in ahead.labels.items() if n in behind.labels and cost + behind.labels[n][0] == best)
    return best, min(ahead.labels[n][1] + behind.labels[n][1] for n in crossings)


def edited(sources: list[tuple[str, str]], initials: str, entry: int = START) -> list[tuple[str, str]]:
    """The messages that edits make of (role, text) pairs."""
    out, q, i = [], entry, 0
    for edit in initials:
        if edit in "RI":
            q = _DUE[q]
            out.append(("user" if q == USER else "assistant", sources[i][1] if edit == "R" else ""))
        elif edit == "K":
            q = _KEEP[sources[i][0][:1]][q]
            out.append(sources[i])
        i += edit != "I"
    return out


# --- chunks ----------------------------------------------------------------------------------


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal messages of a batch as one row, so that a message repeated without end doesn't fill one task."""
    for batch in batches:
        together = pa.Table.from_batches([batch]).group_by(["c", "t", "r", "x"], use_threads=False).aggregate([("n", "sum")])
        yield from together.select(["c", "t", "r", "x", "n_sum"]).rename_columns(["c", "t", "r", "x", "n"]).to_batches()


_FULL = re.compile("[^\\x20\\x09-\\x0D]")
_SPACE = " \t\n\x0b\x0c\r"


class _Chunk:
    """Consecutive messages of one conversation."""

    def __init__(self, conv, begins):
        self.conv, self.begins, self.chars = conv, begins, 0
        self.rows, self.sources = [], []
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.turns: list = []  # first, last, least, most, how many different

    def add(self, turn, role, text, repeated):
        blank = not _FULL.search(text)
        duplicate = repeated and not blank
        cut_off = int(not blank and not duplicate and text.rstrip(_SPACE)[-1] not in ".!?")
        if self.rows and self.rows[-1][0] + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.blank += blank
        self.duplicate += duplicate
        self.truncated += cut_off
        gone = blank or duplicate
        self.rows.append((role[:1], gone, cut_off))
        self.sources.append(("", "") if gone else (role, text))
        self.chars += 0 if gone else len(text)
        t = self.turns
        if not t:
            self.turns = [turn, turn, turn, turn, int(turn is not None)]
        elif turn != t[1]:  # sorted, nulls first
            self.turns = [t[0], turn, turn if t[2] is None else t[2], turn, t[4] + 1]

    def close(self, at, ends):
        """The chunk as a row; ``ends``: the conversation ends here, goes on, or (None) may do either."""
        whole = bool(self.begins and ends)
        found = [None] * (4 * _OUT)
        for entry in (START,) if self.begins else range(4):
            for way in range(_OUT):
                if ends is None or (way == 4) == ends:
                    to = _ENDS if way == 4 else (way,)
                    found[entry * _OUT + way] = cheapest(self.rows, entry=entry, exits=to, last=way == 4)
        # Among ways of one entry, strings are compared by their rank.
        place = {text: k for k, text in enumerate(sorted({f[1] for f in found if f}))}
        return (
            self.conv, at, whole, [f and f[0] for f in found], [f and place[f[1]] for f in found], [f and f[1] for f in found],
            [r for r, _ in self.sources], [x for _, x in self.sources], self.rows[0][0], self.rows[-1][0],
            len(self.rows), self.blank, self.duplicate, self.truncated, self.illegal, *self.turns,
        )


_STATS = "first_initial string, last_initial string, n_rows bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, turn_first bigint, turn_last bigint, turn_least bigint, turn_most bigint, turns bigint"
_STAT_NAMES = [part.split()[0] for part in _STATS.split(", ")]
_CHUNK = f"at bigint, whole boolean, costs array<int>, ranks array<int>, audits array<string>, roles array<string>, texts array<string>, {_STATS}"


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _batches(rows: Iterator[tuple], schema: pa.Schema, weight) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of bounded weight."""
    held, total = [], 0
    for row in rows:
        held.append(row)
        total += weight(row)
        if total >= CHUNK_CHARS or len(held) >= 4096:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, total = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _cutter(schema: T.StructType, most_rows: int):
    """Sorted messages to chunks."""

    def rows_of(batches):
        number = TaskContext.get().partitionId() << 32
        chunk, marked, marks, before = None, None, set(), None
        for batch in batches:
            for c, t, r, head, kind, x, n, h1, h2 in zip(*[col.to_pylist() for col in batch.columns]):
                if marked != (c, t, r, head):
                    marked, marks = (c, t, r, head), set()
                if kind == 0:
                    marks.add((h1, h2))
                    continue
                if chunk is None:
                    chunk = _Chunk(c, False)  # the task before may have its beginning
                elif chunk.conv != c:
                    yield chunk.close(number, True)
                    number += 1
                    chunk = _Chunk(c, True)
                repeated = (h1, h2) in marks or before == (c, t, r, x)
                before = (c, t, r, x)
                for _ in range(n):
                    if len(chunk.rows) >= most_rows or chunk.chars >= CHUNK_CHARS:
                        yield chunk.close(number, False)
                        number += 1
                        chunk = _Chunk(c, False)
                    chunk.add(t, r, x, repeated)
                    repeated = True
        if chunk is not None:
            yield chunk.close(number, None)

    def run(batches):
        return _batches(rows_of(batches), _arrow(schema), lambda row: sum(map(len, row[7])))

    return run


def _ways(chunks: pd.DataFrame) -> pd.DataFrame:
    """For the chunks of one conversation, a few numbers each: after which role each begins, how it ends."""
    chunks = chunks.sort_values("at")
    costs, ranks = list(chunks["costs"]), list(chunks["ranks"])
    n, never = len(costs), float("inf")

    def price(k, q, way):
        cost = costs[k][q * _OUT + way]
        return never if cost is None or cost != cost else cost

    rest = [[0.0] * 4 for _ in range(n + 1)]  # cost from a chunk's beginning to the end of the conversation
    for k in range(n - 1, -1, -1):
        for q in range(4):
            rest[k][q] = price(k, q, 4) if k == n - 1 else min(price(k, q, way) + rest[k + 1][way] for way in range(4))
    entries, ways, q = [], [], START
    for k in range(n):
        options = [4] if k == n - 1 else [w for w in range(4) if price(k, q, w) + rest[k + 1][w] == rest[k][q]]
        way = min(options, key=lambda w: ranks[k][q * _OUT + w])
        entries.append(q)
        ways.append(way)
        q = way
    return pd.DataFrame({"at": chunks["at"].to_numpy(), "entry": entries, "way": ways})


def _writer(schema: T.StructType):
    """Chunks with their entry and way to chunks with edits and messages."""

    def rows_of(batches):
        for batch in batches:
            for c, at, whole, costs, audits, roles, texts, entry, way, *stats in zip(*[col.to_pylist() for col in batch.columns]):
                pick = entry * _OUT + way
                messages = [{"role": r, "text": x} for r, x in edited(list(zip(roles, texts)), audits[pick], entry)]
                yield c, at, whole, costs[pick], audits[pick], messages, *stats

    def run(batches):
        return _batches(rows_of(batches), _arrow(schema), lambda row: sum(len(m["text"]) for m in row[5]))

    return run


def repair(
    messages: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    copies: str | None = None, chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Repaired conversations in chunks: conv, at, whole, cost, audit, messages (role, text), and counts.

    A conversation is one chunk (``whole``) or several, ascending by ``at``; ``audit`` has the
    initials of its edits, ``blank``, ``duplicate`` and ``truncated`` count each message's first fault,
    ``illegal`` neighbours that are not system-user, user-assistant or assistant-user.

    Messages come in the order of ``turn`` (nulls first), then role, then text; equal ones are
    repeats, as are a role and text said in an earlier turn.  ``copies`` names a column that
    says how often a row counts.  Null role and text read as one blank; a null conversation is
    one of its own.  Texts may have any length.  An empty table gives an empty one; other columns
    are not read, whatever their names.
    """
    blank = F.lit(" ")
    n = F.lit(1) if copies is None else F.col(copies)
    rows = messages.select(
        F.col(conv).alias("c"), F.col(turn).cast("bigint").alias("t"), F.coalesce(F.col(role), blank).alias("r"),
        F.coalesce(F.col(text), blank).alias("x"), n.cast("bigint").alias("n"),
    )
    kind = rows.schema["c"].dataType
    rows = rows.mapInArrow(_combined, rows.schema)
    # 128 bits tell a conversation's role and text apart.
    rows = rows.select(
        "c", "t", "r", F.substring("x", 1, 16).alias("head"), F.lit(1).alias("kind"), "x", "n",
        F.xxhash64("c", "r", "x").alias("h1"), F.xxhash64(F.lit(1), "c", "r", "x").alias("h2"),
    )
    keyed = materialise(rows.where(F.col("x").rlike(_FULL.pattern)).select("c", "t", "r", "head", "h1", "h2"), "messages")
    said = keyed.groupBy("h1", "h2").agg(F.min(F.struct("t")).alias("first"), F.max(F.struct("t")).alias("last"))
    again = said.where(~F.col("first.t").eqNullSafe(F.col("last.t"))).select("h1", "h2", F.col("first.t").alias("first"))
    later = skew_join(keyed, again, ["h1", "h2"], spread=["t"]).where(~F.col("t").eqNullSafe(F.col("first")))
    marks = later.select(
        "c", "t", "r", "head", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("x"), F.lit(0).cast("bigint").alias("n"), "h1", "h2"
    ).distinct()
    # Messages and the marks of their repeats meet by sorting; texts move here and nowhere else.
    parts = int(messages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    together = rows.union(marks).repartitionByRange(parts, "c", "t", "r", "head")
    together = together.sortWithinPartitions("c", "t", "r", "head", "kind", "x")
    schema = T.StructType([T.StructField("c", kind), *T.StructType.fromDDL(_CHUNK).fields])
    chunks = materialise(together.mapInArrow(_cutter(schema, chunk_rows), schema), "chunks")
    parted = chunks.where(~F.col("whole"))
    ways = parted.select("c", "at", "costs", "ranks").groupBy("c").applyInPandas(_ways, "at bigint, entry int, way int")
    whole = chunks.where("whole").withColumn("entry", F.lit(START)).withColumn("way", F.lit(4))
    solved = whole.unionByName(parted.join(ways, "at"))
    solved = solved.select("c", "at", "whole", "costs", "audits", "roles", "texts", "entry", "way", *_STAT_NAMES)
    out = f"at bigint, whole boolean, cost bigint, audit string, messages array<struct<role: string, text: string>>, {_STATS}"
    schema = T.StructType([T.StructField("c", kind), *T.StructType.fromDDL(out).fields])
    return solved.mapInArrow(_writer(schema), schema).withColumnRenamed("c", conv)


def repaired_messages(chunks: DataFrame) -> DataFrame:
    """The messages of repaired conversations as rows: conversation, at, place in the chunk, role, text."""
    conv = chunks.columns[0]
    return chunks.select(conv, "at", F.posexplode("messages").alias("place", "_m")).select(conv, "at", "place", "_m.role", "_m.text")


# --- one row per conversation ------------------------------------------------------------------

_DIGEST = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"


def _digester(schema: T.StructType):
    """Chunks sorted by conversation to a row per conversation; holds one batch and the conversation's initials."""

    def rows_of(batches):
        sums = None
        for batch in batches:
            for row in batch.to_pylist():
                c = row["c"]
                if sums is None or sums["c"] != c:
                    if sums is not None:
                        yield finished(sums)
                    sums = {"c": c, "n": [0] * 6, "audit": [], "hash": hashlib.sha256(), "said": False, "last": None, "turns": None}
                illegal, turns = row["illegal"], row["turns"]
                if sums["last"] is not None:
                    illegal += sums["last"] + row["first_initial"] not in ("su", "ua", "au")
                    turns -= row["turn_first"] is not None and row["turn_first"] == sums["until"]
                new = (row["blank"], row["duplicate"], row["truncated"], illegal, row["cost"], turns)
                sums["n"] = [a + b for a, b in zip(sums["n"], new)]
                sums["last"], sums["until"] = row["last_initial"], row["turn_last"]
                sums["audit"].append(row["audit"])
                if sums["turns"] is None and row["turn_least"] is not None:
                    sums["turns"] = row["turn_least"]
                sums["most"] = row["turn_most"]
                for m in row["messages"]:
                    sums["hash"].update((("\n" if sums["said"] else "") + m["role"] + ":" + m["text"]).encode())
                    sums["said"] = True
        if sums is not None:
            yield finished(sums)

    def finished(sums):
        *counts, cost, turns = sums["n"]
        gaps = 0 if sums["turns"] is None else sums["most"] - sums["turns"] + 1 - turns
        return sums["c"], gaps, *counts, cost, "".join(sums["audit"]), sums["hash"].hexdigest()

    def run(batches):
        return _batches(rows_of(batches), _arrow(schema), lambda row: len(row[7]))

    return run


def digest(chunks: DataFrame) -> DataFrame:
    """One row per conversation: turns missing between the first and last, counts, cost, audit and the hash of what it says.

    A hash reads its conversation in order; a conversation in several chunks passes one task chunk by chunk.
    """
    conv = chunks.columns[0]
    inner = chunks.withColumnRenamed(conv, "c")
    schema = T.StructType([inner.schema["c"], *T.StructType.fromDDL(_DIGEST).fields])
    parts = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    run = _digester(schema)
    whole = inner.where("whole").mapInArrow(run, schema)
    parted = inner.where("NOT whole").repartition(parts, "c").sortWithinPartitions("c", "at").mapInArrow(run, schema)
    return whole.union(parted).withColumnRenamed("c", conv)


# --- damage ------------------------------------------------------------------------------------


def damage(
    messages: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """Messages with planted faults, by ``crc32(conv:turn) % 20``, and a column ``copies``.

    0 drops a message, 1 empties it, 2 removes its ``.``, ``!`` and ``?``, 3 repeats it, 4 makes
    it the user's.  Null values read as one blank, a null conversation or turn in the sum only.
    """
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col(conv).cast("string"), blank), F.lit(":"), F.coalesce(F.col(turn).cast("string"), blank))
    code = F.crc32(key.cast("binary")) % 20
    said = F.coalesce(F.col(text), blank)
    said = F.when(code == 1, "").when(code == 2, F.regexp_replace(said, "[.!?]", "")).otherwise(said)
    who = F.when(code == 4, "user").otherwise(F.coalesce(F.col(role), blank))
    copies = F.when(code == 0, 0).when(code == 3, 2).otherwise(1)
    return messages.select(
        F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), who.alias("role"), said.alias("text"), copies.alias("copies")
    )


def digest_of_damaged(damaged: DataFrame) -> DataFrame:
    """``digest`` of the repair of ``damage``'s rows, with conversations that lost every message."""
    found = digest(repair(damaged.where("copies > 0"), copies="copies"))
    lost = damaged.groupBy("conv_id").agg(F.max("copies").alias("_left")).where("_left = 0")
    empty = hashlib.sha256(b"").hexdigest()
    zeros = [F.lit(0).cast("bigint").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return found.unionByName(lost.select("conv_id", *zeros, F.lit("").alias("audit"), F.lit(empty).alias("repaired_sha256")))
