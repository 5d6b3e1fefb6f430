"""Conversation repair against a plain recursion over all edits."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest

from shelfcast.llm import conversation_repair as cr

SMALL = "/root/testdata/sf0.001/conversations.parquet"
NEXT = {"": "u", "s": "u", "a": "u", "u": "a"}


def plain_edits(rows, entry=""):
    """(cost, initials) by recursion from the end, rows of (initial, has to go, cut off)."""

    @lru_cache(None)
    def best(i, q, inserted):
        found = [(0, "")] if i == len(rows) and q in ("", "a") else []

        def via(cost, edit, *to):
            rest = best(*to)
            if rest is not None:
                found.append((cost + rest[0], edit + rest[1]))

        if i < len(rows):
            initial, forced, cut = rows[i]
            via(3, "D", i + 1, q, 0)
            if not forced:
                if initial == NEXT[q] or (initial == "s" and q == ""):
                    via(cut, "K", i + 1, initial, 0)
                via(2 + cut, "R", i + 1, NEXT[q], 0)
        if inserted < 3:
            via(2, "I", i, NEXT[q], inserted + 1)
        return min(found, default=None)

    for i in range(len(rows), 0, -1):  # keeps the recursion flat
        for q in NEXT:
            best(i, q, 0)
    return best(0, entry, 0)


def plain_rows(rows):
    """The digest of each conversation of (conv, turn, role, text) rows, by the query's rules."""
    convs = {}
    for conv, turn, role, text in rows:
        kept = convs.setdefault(conv, [])
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(code, text)
        kept += [(turn, "user" if code == 4 else role, text)] * {0: 0, 3: 2}.get(code, 1)
    out = set()
    for conv, said in convs.items():
        said.sort(key=lambda m: (m[0] is not None, m[0] or 0, m[1].encode(), m[2].encode()))
        seen, lattice, faults = set(), [], {"b": 0, "d": 0, "t": 0}
        for _, role, text in said:
            last = re.findall("[^\\x20\\x09-\\x0D]", text)[-1:]
            fault = "b" if not last else "d" if (role, text) in seen else "t" if last[0] not in ".!?" else ""
            seen.add((role, text))
            if fault:
                faults[fault] += 1
            lattice.append((role[:1], fault in ("b", "d") and fault != "", int(fault == "t")))
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(lattice, lattice[1:]))
        cost, audit = plain_edits(tuple(lattice))
        i, q, lines = 0, "", []
        for edit in audit:
            if edit == "K":
                q = lattice[i][0]
                lines.append(f"{said[i][1]}:{said[i][2]}")
            elif edit in "RI":
                q = NEXT[q]
                lines.append(("user" if q == "u" else "assistant") + ":" + (said[i][2] if edit == "R" else ""))
            i += edit != "I"
        turns = {m[0] for m in said if m[0] is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out.add((conv, gaps, faults["b"], faults["d"], faults["t"], illegal, cost, audit, sha))
    return out


def digest(spark, rows, **options):
    docs = spark.createDataFrame([(*r, "x", 7) for r in rows], "conv_id long, turn long, role string, text string, c string, at int")
    return cr.digest_of_damaged(cr.damage(docs)) if not options else cr.digest(
        cr.repair((d := cr.damage(docs)).where("copies > 0"), copies="copies", **options)
    )


@pytest.mark.parametrize("seed", range(40))
def test_cheapest_edits_are_those_of_a_plain_recursion(seed):
    rng = random.Random(seed)
    for _ in range(40):
        rows = [(rng.choice("suuaaax"), rng.random() < 0.2, int(rng.random() < 0.3)) for _ in range(rng.randrange(9))]
        assert cr.cheapest(rows) == plain_edits(tuple(rows)), rows


def random_rows(seed, convs=60):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "tool", "", None]
    texts = ["Yes.", "No!", "cut off", "why? ", " \t", "", None, "é 日本。", "a.b\n"]
    rows = []
    for conv in [None, *range(convs)]:
        for turn in range(rng.randrange(1, 9)):
            t = rng.choice([turn, turn, turn, None, turn * 3])
            rows += [(conv, t, rng.choice(roles[:2] * 4 + roles), rng.choice(texts[:3] * 3 + texts) )] * rng.choice([1, 1, 1, 2])
    rows += [(1000 + i, 0, "user", "Hi.") for i in range(40)]
    return rows


def test_rows_are_those_of_the_plain_version(spark):
    rows = random_rows(1)
    got = [tuple(r) for r in digest(spark, rows).collect()]
    want = plain_rows(rows)
    assert set(got) == want and len(got) == len(want)
    assert any(r[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for r in got)


def test_chunks_of_long_conversations_give_the_same(spark):
    rng = random.Random(5)
    rows = [(7, t // 2 if t % 50 else None, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice(["A.", "b", " ", f"{t}!", f"{t}"])) for t in range(400)]
    rows += [(8, None, "user", "same.")] * 300 + random_rows(2, 10)
    whole = {tuple(r) for r in digest(spark, rows).collect()}
    left = {r for r in whole if r[7]}
    for size in (1, 3, 7):
        assert {tuple(r) for r in digest(spark, rows, chunk_rows=size).collect()} == left
    assert left == {r for r in plain_rows(rows) if r[7]}


def test_given_conversations(spark):
    given = spark.read.parquet(SMALL)
    rows = [tuple(r) for r in given.select("conv_id", "turn", "role", "text").collect()]
    got = {tuple(r) for r in cr.digest_of_damaged(cr.damage(given)).collect()}
    assert got == plain_rows(rows)


def test_repaired_messages_long_texts_and_empty_tables(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "assistant", "x" * 3_000_000), (1, 2, "assistant", "Well."), (2, 0, "user", "")]
    docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    chunks = cr.repair(docs)
    said = [tuple(r) for r in cr.repaired_messages(chunks).orderBy("conv_id", "at", "place").select("conv_id", "role", "text").collect()]
    # The cut-off message as the user's costs 2 + 1; deleting it and inserting the user's 3 + 2.
    assert said == [(1, "system", "Be kind."), (1, "user", rows[1][3]), (1, "assistant", "Well.")]
    # A chunk is closed once it has a million characters.
    assert {(r.audit, r.cost) for r in chunks.collect()} == {("K", 0), ("R", 3), ("D", 3)}
    assert {(r.audit, r.cost) for r in cr.digest(chunks).collect()} == {("KRK", 3), ("D", 3)}
    assert cr.repair(docs.limit(0)).isEmpty() and cr.digest_of_damaged(cr.damage(docs.limit(0))).isEmpty()
