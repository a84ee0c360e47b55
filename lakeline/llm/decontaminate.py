"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit check.

Texts and items are sequences of lower-cased words.  An item occurs in a document
when some stretch of its words is within ``1 - similarity`` of the item's length in
word edits.

A CGK walk writes, at each step, the word under its pointer and then moves on or
stays as a random function of step and word says; sequences at small edit distance
give outputs at small Hamming distance.  Windows at every word position of a
document are embedded by several walks, keys sample a few output positions each,
and a key equal to an item's makes a candidate.  Candidates are verified exactly by
bit-parallel edit distance over the words around them.  Before that, positions
whose item-sized window holds too few word pairs of the benchmark are passed over:
an edit destroys two pairs at most, so no occurrence is lost by it.

Documents are never shuffled.  The benchmark is taken in blocks of ``block_items``
items or 4 MB of their text; a block's tables are broadcast, which bounds them whatever
the size of the benchmark.  Items of more than 256 words are searched by parts of that
size: an occurrence within the allowed edits has a part within its share of them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeline.llm.common import saved

# Scripts written without spaces between words: there each character counts as a word.
DENSE = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\U00020000-\U0003ffff"
WORD = re.compile(rf"[^\W{DENSE}]+|(?=\w)[{DENSE}]")
PART = 256  # words of an item that are searched as one
MOVES = 1 << 12  # classes of words that move a walk alike
BLOCK_BYTES = 4 << 20  # text of the items of a block, about
PAIR_BITS = 22
HITS = "array<struct<item_id: long, similarity: double, start_word: long, end_word: long>>"


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def pair_slot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    mixed = (a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(64 - PAIR_BITS)).astype(np.int64)


def best_match(item: list[int], text: list[int], most: int) -> tuple[int, int] | None:
    """(distance, end) of the stretch of ``text`` closest to ``item``, if within ``most`` edits.

    Bit-parallel dynamic programming; of equal distances the first end.
    """
    n = len(item)
    at: dict[int, int] = {}
    for i, w in enumerate(item):
        at[w] = at.get(w, 0) | 1 << i
    full, top = (1 << n) - 1, 1 << (n - 1)
    plus, minus, score, best = full, 0, n, None
    for end, w in enumerate(text, 1):
        eq = at.get(w, 0)
        x = eq | minus
        d = ((((x & plus) + plus) ^ plus) | x) & full
        hp, hm = minus | ~(d | plus) & full, d & plus
        score += bool(hp & top) - bool(hm & top)
        hp, hm = hp << 1 & full, hm << 1 & full
        plus, minus = hm | ~(d | hp) & full, hp & d
        if score <= most and (best is None or score < best[0]):
            best = score, end
    return best


class ItemBlock:
    """What a task needs to find the occurrences of a block of items."""

    def __init__(self, items: list[tuple[int, str]], similarity: float, min_words: int, walks: int, tables: int, sampled: int, seed: int, verbatim_words: int = 3):
        split = [(i, w) for i, t in items if len(w := words_of(t)) >= min(min_words, verbatim_words)]
        self.ids, self.similarity = [i for i, _ in split], similarity
        self.vocab = {w: c for c, w in enumerate(sorted({w for _, ws in split for w in ws}), 1)}
        self.items = [[self.vocab[w] for w in ws] for _, ws in split]
        self.pad, self.base = len(self.vocab) + 1, len(self.vocab) + 2
        self.pairs = np.zeros(1 << PAIR_BITS, bool)
        for x in self.items:
            a = np.array(x)
            self.pairs[pair_slot(a[:-1], a[1:])] = True
        # An item is searched by parts: within so many edits of the whole, one part is within its share of them.
        self.parts, self.short = [], []
        for i, x in enumerate(self.items):
            if len(x) < min_words:
                self.short.append(i)
                continue
            n = -(-len(x) // PART)
            cuts = [len(x) * k // n for k in range(n + 1)]
            self.parts += [(i, a, x[a:b]) for a, b in zip(cuts, cuts[1:])]
        self.gap = max([len(x) + self.edits(len(x)) for _, _, x in self.parts] + [len(self.items[i]) for i in self.short], default=0) + 1
        rng = np.random.default_rng(seed)
        longest = 2 * max((len(x) for _, _, x in self.parts), default=0)
        self.moves = rng.integers(0, 2, (walks, longest, MOVES), np.int8)
        self.classes = [self.length_class(some, tables, sampled, rng) for some in self.by_length()]
        self.exact = [self.exact_class(n) for n in sorted({len(self.items[i]) for i in self.short})]

    def edits(self, n: int) -> int:
        return int((1 - self.similarity) * n + 1e-9)

    def by_length(self) -> Iterator[list[int]]:
        """Parts in classes of about one length."""
        some: list[int] = []
        for i in sorted(range(len(self.parts)), key=lambda i: len(self.parts[i][2])):
            if some and len(self.parts[i][2]) > 1.25 * len(self.parts[some[0]][2]):
                yield some
                some = []
            some.append(i)
        if some:
            yield some

    def length_class(self, some: list[int], tables: int, sampled: int, rng: np.random.Generator) -> dict:
        lengths = [len(self.parts[i][2]) for i in some]
        steps = 2 * min(lengths)
        flat = np.concatenate([np.array([*self.parts[i][2], *[self.pad] * self.gap]) for i in some])
        starts = np.cumsum([0] + [n + self.gap for n in lengths[:-1]])
        keys = []
        for walk in range(len(self.moves)):
            out = self.embed(flat, starts, steps, walk)
            for _ in range(tables):
                cols = np.sort(rng.choice(steps, min(sampled, steps), replace=False))
                key = self.key(out, cols)
                whole = np.flatnonzero(~(out[:, cols] == self.pad).any(1))
                order = whole[np.argsort(key[whole], kind="stable")]
                keys.append((walk, cols, key[order], np.array(some)[order]))
        need = min(n - 1 - 2 * self.edits(n) for n in lengths)
        return {"steps": steps, "need": need, "span": max(n + self.edits(n) for n in lengths), "keys": keys}

    def embed(self, flat: np.ndarray, starts: np.ndarray, steps: int, walk: int) -> np.ndarray:
        out, at = np.empty((len(starts), steps), np.int64), starts.astype(np.int64)
        for t in range(steps):
            out[:, t] = now = flat[at]
            at = at + self.moves[walk, t, now & (MOVES - 1)]
        return out

    def exact_class(self, n: int) -> tuple[int, np.ndarray, np.ndarray]:
        """(words, sorted keys, items) of the short items of ``n`` words, which are found verbatim."""
        some = np.array([i for i in self.short if len(self.items[i]) == n])
        key = self.key(np.array([self.items[i] for i in some]), np.arange(n))
        order = np.argsort(key, kind="stable")
        return n, key[order], some[order]

    def verbatim(self, flat: np.ndarray) -> Iterator[tuple[int, int]]:
        """(position in ``flat``, item) of every short item that is there word for word."""
        for n, keys, owners in self.exact:
            if len(flat) < n:
                continue
            key = np.zeros(len(flat) - n + 1, np.int64)
            for c in range(n):
                key = key * self.base + flat[c : c + len(key)]
            a, b = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
            for at in np.flatnonzero(b > a).tolist():
                here = flat[at : at + n].tolist()
                yield from ((at, int(i)) for i in owners[a[at] : b[at]] if self.items[i] == here)

    def key(self, out: np.ndarray, cols: np.ndarray) -> np.ndarray:
        key = np.zeros(len(out), np.int64)
        for c in cols:
            key = key * self.base + out[:, c]
        return key

    def candidates(self, flat: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(positions in ``flat``, items) that share a key."""
        hit = self.pairs[pair_slot(flat[:-1], flat[1:])] & (flat[:-1] > 0) & (flat[1:] > 0)
        count = np.concatenate([[0], np.cumsum(hit)])
        here = np.arange(len(flat))
        for c in self.classes:
            upto = np.minimum(here + c["span"] - 1, len(hit))
            near = np.flatnonzero(count[upto] - count[np.minimum(here, len(hit))] >= max(1, c["need"]))
            for i in range(0, len(near), 1 << 14):
                some = near[i : i + (1 << 14)]
                walk, out = -1, None
                for w, cols, keys, owners in c["keys"]:
                    if w != walk:
                        walk, out = w, self.embed(flat, some, c["steps"], w)
                    key = self.key(out, cols)
                    a, b = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
                    met = np.flatnonzero(b > a)
                    size = (b - a)[met]
                    which = np.repeat(a[met] - np.cumsum(size) + size, size) + np.arange(size.sum())
                    yield np.repeat(some[met], size), owners[which]

    def find(self, texts: list[str | None]) -> list[list[dict]]:
        """The best occurrence of each item in each text."""
        out: list[list[dict]] = [[] for _ in texts]
        codes = [np.fromiter(map(self.vocab.get, w, repeat(0)), np.int64, len(w)) for w in map(words_of, texts)]
        if not self.items or not codes:
            return out
        sizes = np.array([len(c) for c in codes])
        begins = np.cumsum(sizes + self.gap) - sizes - self.gap
        pad = np.full(self.gap, self.pad, np.int64)
        flat = np.concatenate([x for c in codes for x in (c, pad)])
        seen: set[tuple[int, int]] = set()
        for pos, i in sorted(self.verbatim(flat)):
            d = int(np.searchsorted(begins, pos, "right") - 1)
            if (d, i) not in seen:  # the first of equal ones
                seen.add((d, i))
                start = pos - int(begins[d])
                out[d].append({"item_id": self.ids[i], "similarity": 1.0, "start_word": start, "end_word": start + len(self.items[i])})
        found = [x for x in self.candidates(flat) if len(x[0])]
        if not found:
            return out
        at, part = (np.concatenate(x) for x in zip(*found))
        doc = np.searchsorted(begins, at, "right") - 1
        item, offset = (np.array([p[k] for p in self.parts])[part] for k in (0, 1))
        at = at - offset  # where the item begins, but for edits before the part
        order = np.lexsort((at, item, doc))
        at, item, doc = at[order], item[order], doc[order]
        new = np.flatnonzero((np.diff(item, prepend=-1) != 0) | (np.diff(doc, prepend=-1) != 0))
        for a, b in zip(new, [*new[1:], len(at)]):
            d, i, words = int(doc[a]), int(item[a]), self.items[int(item[a])]
            most = self.edits(len(words))
            slip = most if len(words) <= PART else 2 * most
            first = max(0, int(at[a] - begins[d]) - slip)
            text = codes[d][first : int(at[b - 1] - begins[d]) + len(words) + most + slip].tolist()
            if best := best_match(words, text, most):
                back = best_match(words[::-1], text[: best[1]][::-1], best[0])
                end = first + best[1]
                out[d].append({"item_id": self.ids[i], "similarity": 1 - best[0] / len(words), "start_word": end - back[1], "end_word": end})
        return out


def blocks(items: DataFrame, block_items: int, **how) -> Iterator[ItemBlock]:
    """The benchmark in blocks of about ``block_items`` items or ``BLOCK_BYTES`` of text each."""
    items = items.select(F.col("item_id").cast("long"), "text").where("text IS NOT NULL")
    rows, size = items.select(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    n = max(-(-rows // block_items), -(-size // BLOCK_BYTES))
    for k in range(n):
        mine = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).orderBy("item_id", "text").collect()
        yield ItemBlock([tuple(r) for r in mine], **how)


def hits_in(docs: DataFrame, block: ItemBlock, text: Column, most_bytes: int = 2 << 20) -> Column:
    shared = docs.sparkSession.sparkContext.broadcast(block)

    @F.pandas_udf(HITS)
    def hits(texts: pd.Series) -> pd.Series:
        out, some, size = [], [], 0
        for t in texts:
            some.append(t)
            size += len(t or "")
            if size > most_bytes:
                out += shared.value.find(some)
                some, size = [], 0
        return pd.Series(out + shared.value.find(some), dtype=object)

    return hits(text)


DEFAULTS = {"similarity": 0.8, "min_words": 8, "walks": 8, "tables": 12, "sampled": 3, "seed": 9, "verbatim_words": 3}


def contaminated(docs: DataFrame, items: DataFrame, block_items: int = 2000, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row per document and item that occurs in it: doc_id, item_id, similarity, start_word, end_word.

    The row gives the best occurrence (words counted from 0, end exclusive; of equal
    ones the first).  A word is a run of letters, digits and underscores, or one character
    of a script without spaces.  Null and empty texts hold nothing.  Items with fewer than
    ``min_words`` words are found word for word only; those under ``verbatim_words``, and
    null ones, never: so few words prove nothing.
    Repeated documents each give their rows, repeated items too; with either table
    empty the result is empty.  Other columns are ignored.
    """
    how = DEFAULTS | how
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    out = None
    for block in blocks(items, block_items, **how):
        hits = rows.select("doc_id", F.explode(hits_in(rows, block, F.col("text"))).alias("hit")).select("doc_id", "hit.*")
        out = hits if out is None else out.unionAll(hits)
    if out is None:
        out = rows.where("false").select("doc_id", *(F.lit(None).cast(t).alias(c) for c, t in (("item_id", "long"), ("similarity", "double"), ("start_word", "long"), ("end_word", "long"))))
    return out


def drop_contaminated(docs: DataFrame, items: DataFrame, block_items: int = 2000, text_col: str = "text", **how) -> DataFrame:
    """The rows of docs, all columns, in which no item occurs."""
    how = DEFAULTS | how
    for k, block in enumerate(blocks(items, block_items, **how)):
        rows = saved(docs, "clean") if k else docs
        held = rows.select(F.struct("*").alias("doc"), hits_in(rows, block, F.col(text_col)).alias("hits"))
        docs = held.where(F.size("hits") == 0).select("doc.*")
    return docs
