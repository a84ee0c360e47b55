"""Plain single-process versions of the corpus operators, for comparison."""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import xxhash

SF = "/root/testdata/sf0.001"


class Sets:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def simhash(text: str | None, size: int = 4) -> int:
    data = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    words = re.findall(rb"[^\x20\x09-\x0D]+", data)
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or [b" ".join(words)]
    return majority([xxhash.xxh64_intdigest(x, 42) for x in shingles])


def majority(hashes: list[int]) -> int:
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def simhash_groups(rows: list[tuple[int | None, str | None]], distance: int = 4) -> list[tuple]:
    fps = np.array([simhash(t) for _, t in rows], np.uint64)
    sets = Sets(len(rows))
    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= distance):
            sets.join(i, int(j))
    best: dict[int, int | None] = {}
    for i, (d, _) in enumerate(rows):
        r = sets.find(i)
        best[r] = d if best.get(r) is None else min(best[r], d if d is not None else best[r])
    return sorted(((d, format(int(fps[i]), "016x"), best[sets.find(i)]) for i, (d, _) in enumerate(rows)), key=str)


def levenshtein(a, b) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def closest(item, text) -> int:
    """Least edit distance of ``item`` to any stretch of ``text``."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(text, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return min(row)


def line_fingerprint(line: str) -> int:
    return majority([xxhash.xxh64_intdigest(w) for w in set(line.split(" "))])


def dedup_lines(docs: dict[int, str], distance: int = 3, similarity: float = 0.8) -> dict[int, str]:
    plain = {d: [" ".join(x.lower().split()) for x in t.split("\n")] for d, t in docs.items()}
    distinct = list(dict.fromkeys(x for d in sorted(docs) for x in plain[d] if x))
    fps = np.array([line_fingerprint(x) for x in distinct], np.uint64)
    sets = Sets(len(distinct))
    for i, a in enumerate(distinct):
        for j in np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= distance):
            b = distinct[i + 1 + int(j)]
            if levenshtein(a, b) <= int((1 - similarity) * max(len(a), len(b)) + 1e-9):
                sets.join(i, i + 1 + int(j))
    place, seen, out = {x: i for i, x in enumerate(distinct)}, set(), {}
    for d in sorted(docs):
        stay = []
        for raw, x in zip(docs[d].split("\n"), plain[d]):
            if x:
                root = sets.find(place[x])
                if root in seen:
                    continue
                seen.add(root)
            stay.append(raw)
        out[d] = "\n".join(stay)
    return out


def repeated_windows(docs: dict[int, str], words: int = 50) -> dict[int, set[int]]:
    """Starts of stretches of ``words`` words that an earlier document holds too."""
    where = defaultdict(list)
    for d in sorted(docs):
        split = docs[d].encode().lower().split()
        for i in range(len(split) - words + 1):
            where[tuple(split[i : i + words])].append((d, i))
    out = defaultdict(set)
    for at in where.values():
        for d, i in at:
            if d != at[0][0]:
                out[d].add(i)
    return out
