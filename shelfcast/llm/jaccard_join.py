"""N-gram Jaccard join: groups of texts whose sets of word shingles are alike, and links that connect them.

Groups are exact, by set-relation skipping on inverted lists:

* Texts with equal sets are one class; only one set per class goes further.
* A class puts a prefix of its shingles into the lists, frequent ones last.  Whatever the
  order, two sets that are alike share a shingle of their prefixes.
* Block skip: a list entry carries set size and position, which bound the overlap that is
  still possible, so entries of unfit size blocks and positions never meet.
* Connecting links only: in each list one entry, the least edited text, is compared with
  all others first.  After that only entries of different groups still meet; pairs inside
  a group are skipped, not derived, so not all alike pairs are links.  A group of
  a million near copies costs a million comparisons with one set, not their square.

Comparisons look at the prefixes first (the count of shared shingles bounds the overlap)
and at whole sets only for the few pairs left.  Shingles and sets are told apart by
64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.llm.components import components
from shelfcast.llm.shingles import mix, shingle_sets
from shelfcast.session import materialise

# A shingle counts as frequent if it is in one of FREQUENT sets: there are at most
# FREQUENT * (mean size of a set) of them, whatever the number of documents.
FREQUENT = 32_768
# Documents among which a task counts shingles at once, and texts of one numpy call.
BLOCK = 8192
SLICE = 256
# Ids are broadcast up to this count (16 bytes each); beyond it they are joined by shuffle.
BROADCAST_IDS = 1_000_000


def _key(shingles: np.ndarray) -> int:
    """A 64-bit fingerprint of a sorted set."""
    h = mix(shingles + np.uint64(len(shingles)))
    both = h.sum(dtype=np.uint64, keepdims=True) * np.uint64(0x9E3779B97F4A7C15) + np.bitwise_xor.reduce(h, keepdims=True)
    return int(mix(both).view(np.int64)[0])


def _sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[tuple[list, list[np.ndarray]]]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            part = batch.slice(at, SLICE)
            yield part.column(0).to_pylist(), list(shingle_sets(part.column(1), words))


def _numbered(words: int) -> Callable:
    """Per text its set's size and key; besides, shingles frequent among ``BLOCK`` documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: dict[int, np.ndarray] = {}

        def frequent() -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate(list(block.values())), return_counts=True) if block else (np.zeros(0, np.uint64),) * 2
            often = counts >= 3
            block.clear()
            n = int(often.sum())
            return pa.record_batch(
                [pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array(counts[often].astype(np.int64)), pa.array(values[often].view(np.int64))],
                names=["id", "key", "n", "shingle"],
            )

        for ids, sets in _sets(batches, words):
            keys = [_key(s) if len(s) else None for s in sets]
            yield pa.record_batch(
                [pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.nulls(len(ids), pa.int64())],
                names=["id", "key", "n", "shingle"],
            )
            block.update((k, s) for k, s in zip(keys, sets, strict=True) if k is not None)
            if len(block) >= BLOCK:
                yield frequent()
        yield frequent()

    return run


def _prefixes(words: int, percent: int, frequent) -> Callable:
    """Per set its key, size and prefix: rare shingles by hash, then frequent ones by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late = frequent.value
        for _, sets in _sets(batches, words):
            sets = [s for s in sets if len(s)]
            prefixes, rare = [], []
            for s in sets:
                is_late = np.zeros(len(s), dtype=bool)
                if len(late):
                    spot = np.minimum(np.searchsorted(late, s), len(late) - 1)
                    is_late = late[spot] == s
                length = len(s) - -(-percent * len(s) // 100) + 1
                rare.append(len(s) - int(is_late.sum()))
                prefixes.append(np.concatenate([s[~is_late], s[is_late]])[:length])
            yield pa.record_batch(
                [
                    pa.array([_key(s) for s in sets], pa.int64()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(rare, pa.int64()),
                    _lists(prefixes),
                ],
                names=["key", "n", "rare", "prefix"],
            )

    return run


def _whole(words: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets in _sets(batches, words):
            sets = [s for s in sets if len(s)]
            yield pa.record_batch([pa.array([_key(s) for s in sets], pa.int64()), _lists(sets)], names=["key", "shingles"])

    return run


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))


def _alike(shared: Column, n: Column, m: Column, percent: int) -> Column:
    return shared * 100 >= (n + m - shared) * percent


def _least_overlap(n: Column, m: Column, percent: int) -> Column:
    """The smallest intersection with which sets of these sizes can be alike."""
    return F.ceil((n + m) * F.lit(percent) / F.lit(100 + percent) - F.lit(1e-9))


def _fit(n: Column, m: Column, percent: int) -> Column:
    return F.least(n, m) * 100 >= F.greatest(n, m) * percent


class JaccardJoin:
    """One join: ``members`` (a row per text) and ``links`` (verified pairs of
    classes, as many as connect the groups, not all alike pairs).

    ``members`` has ``id``, ``key`` (class; null for an empty set) and ``n`` (set size) for
    each row of ``docs``, repeated rows and null ids included.  Sets are lower-cased A-Z,
    words are runs outside ASCII white space, shingles take ``words`` words; a shorter text
    is one shingle, and a null text or one without words has an empty set that links with
    nothing.  Sets are alike if ``100 * intersection >= percent * union``.
    """

    def __init__(self, docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", words: int = 4, percent: int = 85):
        if not 50 <= percent <= 100:
            raise ValueError("percent between 50 and 100")
        self.words, self.percent = words, percent
        self.docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
        self.spark = docs.sparkSession
        kinds = "id long, key long, n long, shingle long"
        both = materialise(self.docs.mapInArrow(_numbered(words), kinds), "members")
        self.members = both.where("shingle IS NULL").drop("shingle")
        self.frequent = both.where("shingle IS NOT NULL").groupBy("shingle").agg(F.sum("n").alias("n"))

    def _prefix_table(self) -> DataFrame:
        total = self.members.where("key IS NOT NULL").count()
        # At most FREQUENT * (mean set size) shingles reach this share of the sets.
        often = self.frequent.where(F.col("n") >= max(6, total // FREQUENT)).select("shingle").toPandas()["shingle"]
        late = self.spark.sparkContext.broadcast(np.sort(often.to_numpy(dtype=np.int64).view(np.uint64)))
        rows = self.docs.mapInArrow(_prefixes(self.words, self.percent, late), "key long, n long, rare long, prefix array<long>")
        return materialise(rows.dropDuplicates(["key"]), "prefixes")

    def _lists(self, prefixes: DataFrame) -> DataFrame:
        """Entries of lists with two sets or more, and the rank of each list's pivot.

        The pivot is the set with the fewest shingles of its own (rare ones): of a group of
        near copies the least edited one, and the same one in nearly all lists of the group.
        """
        entries = prefixes.select("key", F.col("n").cast("int").alias("n"), "rare", F.posexplode("prefix").alias("at", "shingle"))
        # Rare shingles, then 40 bits of the key: the least is the pivot, found by a plain minimum.
        rank = F.shiftleft(F.col("rare"), 40).bitwiseOR(F.col("key").bitwiseAND(F.lit((1 << 40) - 1)))
        entries = entries.select("shingle", "key", "n", "at", rank.alias("_rank"))
        heads = entries.groupBy("shingle").agg(F.min("_rank").alias("_head"), F.count(F.lit(1)).alias("_many")).where("_many > 1")
        return materialise(entries.join(heads.drop("_many"), "shingle"), "lists")

    def _sets_of(self, pairs: DataFrame) -> DataFrame:
        keys = pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct()
        # Copies combine before they move: a class leaves each task as one row.
        ids = self.members.groupBy("key").agg(F.min("id").alias("id")).join(keys, "key").select("id").distinct()
        ids = materialise(ids, "ids")
        few = ids.count() <= BROADCAST_IDS
        ids = ids.withColumnRenamed("id", "_id")
        docs = self.docs.join(F.broadcast(ids) if few else ids, F.col("id").eqNullSafe(F.col("_id")), "left_semi")
        sets = docs.mapInArrow(_whole(self.words), "key long, shingles array<long>")
        return materialise(sets.dropDuplicates(["key"]), "sets")

    def _verified(self, pairs: DataFrame, prefixes: DataFrame) -> DataFrame:
        """The pairs ``(a, b)`` of classes whose sets are alike."""

        def ends(pairs: DataFrame, sets: DataFrame, value: str) -> DataFrame:
            left = sets.select(F.col("key").alias("a"), F.col(value).alias("_x"))
            right = sets.select(F.col("key").alias("b"), F.col(value).alias("_y"))
            joined = pairs.join(left, "a").join(right, "b")
            return joined.withColumn("_shared", F.size(F.array_intersect("_x", "_y"))).drop("_x", "_y")

        t = F.lit(self.percent)
        rest = F.greatest(F.ceil(F.col("na") * t / 100 - F.lit(1e-9)), F.ceil(F.col("nb") * t / 100 - F.lit(1e-9))) - 1
        likely = ends(pairs, prefixes, "prefix").where(
            F.col("_shared") + rest >= _least_overlap(F.col("na"), F.col("nb"), self.percent)
        )
        likely = materialise(likely.drop("_shared"), "likely")
        sets = self._sets_of(likely)
        good = ends(likely, sets, "shingles").where(_alike(F.col("_shared"), F.col("na"), F.col("nb"), self.percent))
        return good.select("a", "b")

    def links(self) -> DataFrame:
        """Verified links between classes, ``(a, b)``: enough of them that groups are whole, not all alike pairs."""
        prefixes = self._prefix_table()
        lists = self._lists(prefixes)
        fits = lambda n, m, at, bt: _fit(n, m, self.percent) & (
            F.least(n - at, m - bt) >= _least_overlap(n, m, self.percent)
        )
        # Each entry against its list's pivot.
        pivots = lists.where(F.col("_rank") == F.col("_head")).select(
            "shingle", F.col("key").alias("b"), F.col("n").alias("nb"), F.col("at").alias("_bt")
        )
        near = (
            lists.where(F.col("_rank") != F.col("_head"))
            .select("shingle", F.col("key").alias("a"), F.col("n").alias("na"), F.col("at").alias("_at"))
            .join(pivots, "shingle")
            .where(fits(F.col("na"), F.col("nb"), F.col("_at"), F.col("_bt")) & (F.col("a") != F.col("b")))
            .select("a", "b", "na", "nb")
            .distinct()
        )
        first = materialise(self._verified(near, prefixes), "first-links")
        groups = components(first)
        # Entries of one list that are in different groups by now.
        labelled = (
            lists.join(groups.withColumnRenamed("node", "key"), "key", "left")
            .withColumn("root", F.coalesce("root", "key"))
            .select("shingle", "key", "n", "at", "root")
        )
        mixed = labelled.groupBy("shingle").agg(F.min("root").alias("_lo"), F.max("root").alias("_hi")).where("_lo < _hi")
        left = materialise(labelled.join(mixed.select("shingle"), "shingle"), "mixed")
        # Sizes in blocks of the threshold's ratio: only equal or neighbouring blocks can link.
        block = F.floor(F.log(F.col("n").cast("double")) / F.lit(math.log(100 / self.percent)) + F.lit(1e-9)).cast("int")
        if self.percent == 100:
            block = F.col("n")
        left = left.withColumn("_block", block)
        x = left.select("shingle", F.col("key").alias("a"), F.col("n").alias("na"), F.col("at").alias("_at"), F.col("root").alias("_ra"), F.col("_block"))
        y = left.select(
            "shingle", F.col("key").alias("b"), F.col("n").alias("nb"), F.col("at").alias("_bt"), F.col("root").alias("_rb"),
            F.explode(F.array(F.col("_block"), F.col("_block") + 1)).alias("_block"),
        )
        far = (
            x.join(y, ["shingle", "_block"])
            .where(
                (F.col("_ra") != F.col("_rb"))
                & ((F.col("na") > F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b"))))
                & fits(F.col("na"), F.col("nb"), F.col("_at"), F.col("_bt"))
            )
            .select("a", "b", "na", "nb")
            .distinct()
        )
        return materialise(first.unionByName(self._verified(far, prefixes)), "jaccard-links")

    def groups(self) -> DataFrame:
        """``members`` with ``component_id``, the smallest id reachable by links, and ``root`` (class).

        An empty set is alone: its component is its own id.  Null ids are skipped by the
        minimum; a group of null ids has a null component.
        """
        roots = components(self.links())
        full = self.members.where("key IS NOT NULL")
        classes = full.groupBy("key").agg(F.min("id").alias("_least"))
        classes = classes.join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
        least = classes.groupBy("root").agg(F.min("_least").alias("component_id"))
        placed = full.join(classes.select("key", "root").join(least, "root"), "key")
        alone = self.members.where("key IS NULL").withColumn("root", F.lit(None).cast("long")).withColumn("component_id", F.col("id"))
        cols = ["id", "key", "n", "root", "component_id"]
        return placed.select(*cols).unionByName(alone.select(*cols))


def keys_udf(words: int) -> Callable:
    """A column function: the class key of each text, null for an empty set."""

    @F.arrow_udf("long")
    def keys(texts: pa.Array) -> pa.Array:
        out = []
        for at in range(0, len(texts), SLICE):
            out += [_key(s) if len(s) else None for s in shingle_sets(texts.slice(at, SLICE), words)]
        return pa.array(out, pa.int64())

    return keys


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each group: the one with the smallest id (of equal rows, any).

    Rows with empty texts all stay.  Columns pass unchanged under any names.
    """
    inner = [f"c{i}" for i in range(len(docs.columns))]
    key, body = inner[docs.columns.index(id_col)], inner[docs.columns.index(text)]
    groups = JaccardJoin(docs, id_col=id_col, text=text, words=words, percent=percent).groups()
    chosen = (
        groups.where("key IS NOT NULL AND id <=> component_id")
        .groupBy("root")
        .agg(F.min("key").alias("_key"), F.min("component_id").alias("_id"))
        .select("_key", "_id")
    )
    keyed = docs.toDF(*inner).withColumn("_key", keys_udf(words)(F.col(body)))
    best = keyed.withColumnRenamed("_key", "_own").join(
        chosen, (F.col("_own") == F.col("_key")) & F.col(key).cast("long").eqNullSafe(F.col("_id")), "left_semi"
    )
    best = best.dropDuplicates(["_own", key]).drop("_own")
    empty = keyed.where("_key IS NULL").drop("_key")
    return best.unionByName(empty).toDF(*docs.columns)
