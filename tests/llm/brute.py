"""Plain versions that the corpus operators are compared with."""

from __future__ import annotations

import re
from collections import defaultdict

WORD = re.compile("[^\\x20\\x09-\\x0D]+")


def lower_ascii(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def shingle_set(text: str | None, words: int) -> frozenset:
    w = WORD.findall(lower_ascii(text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1)))


def jaccard_groups(docs: list[tuple], words: int, percent: int) -> list[tuple]:
    """(id, set size, component id) per row; links are found through all shared shingles."""
    sets = [shingle_set(text, words) for _, text in docs]
    parent = list(range(len(docs)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    lists = defaultdict(list)
    for i, s in enumerate(sets):
        met = defaultdict(int)
        for x in s:
            for j in lists[x]:
                met[j] += 1
            lists[x].append(i)
        for j, both in met.items():
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(docs):
        if key is not None:
            r = find(i)
            least[r] = min(least.get(r, key), key)
    return [(key, len(s), least.get(find(i)) if s else key) for i, ((key, _), s) in enumerate(zip(docs, sets))]
