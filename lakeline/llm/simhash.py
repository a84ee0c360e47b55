"""SimHash near-dedup by meet-in-the-middle ball hashing.

Two fingerprints within ``distance`` bits have a variant in common among those
that lie within half the distance of each.  Every distinct fingerprint therefore
emits all variants in that ball, variants are shuffled, and fingerprints that meet
on one are verified and linked.

A ball has 2,081 variants at half distance two, too many to ship one by one.  They
are shuffled by their leading ``p`` bits: a fingerprint is sent once to each prefix
that any of its variants has (1 + p + p(p-1)/2 of them) and the variants with that
prefix are unfolded where they arrive.  ``p`` follows the number of fingerprints,
so a prefix holds about a million variants at any size; a prefix that holds more is
split bit by bit within its task, which bounds memory.  Fingerprints that meet on a
variant are linked in a chain, not in all pairs, and a prefix returns only a
spanning forest of its links.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeline.llm.common import hand_down, salt_of, saved
from lakeline.llm.components import components

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
SEED = 42  # fixed value of the fingerprint's contract
BLOCK = 1 << 16


def shingle_hashes(text: bytes, size: int) -> Iterator[np.ndarray]:
    """XXH64 of the word shingles of ``text``, in blocks."""
    words = text.translate(LOWER).split()
    if not words:
        return
    joined = b" ".join(words)
    if len(words) <= size:
        yield np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
        return
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    spans = zip(begins[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist())
    n, h = len(words) - size + 1, xxhash.xxh64_intdigest
    for i in range(0, n, BLOCK):
        k = min(BLOCK, n - i)
        yield np.fromiter((h(joined[a:b], SEED) for _, (a, b) in zip(range(k), spans)), np.uint64, k)


def fingerprint(text: bytes, size: int) -> int:
    """Bit i is set when more than half of the shingle hashes have it set; 0 without words."""
    total, ones = 0, np.zeros(64, np.int64)
    for h in shingle_hashes(text, size):
        total += len(h)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def fingerprints(size: int):
    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t or b"", size) for t in texts], np.uint64).view(np.int64))

    return of


def masks(bits: int, most: int) -> list[np.ndarray]:
    """For r = 0..most: all values of ``bits`` bits with at most r set."""
    found, out = [], []
    for r in range(most + 1):
        found += [sum(1 << b for b in some) for some in combinations(range(bits), r)]
        out.append(np.array(found, np.uint64))
    return out


def to_prefixes(p: int, radius: int):
    """Send each fingerprint to every prefix of its variants, packed by prefix."""
    flips = masks(p, min(radius, p))[-1]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array(batch.column(0), np.int64).view(np.uint64)
            step = max(1, (1 << 22) // len(flips))
            for i in range(0, len(fps), step):
                some = fps[i : i + step]
                to = ((some >> np.uint64(64 - p))[:, None] ^ flips).ravel()
                order = np.argsort(to, kind="stable")
                to, rows = to[order], some[order // len(flips)]
                cuts = np.flatnonzero(np.diff(to)) + 1
                first = np.concatenate([[0], cuts]) if len(to) else cuts
                packs = [x.tobytes() for x in np.split(rows, cuts)] if len(to) else []
                yield pa.RecordBatch.from_arrays([pa.array(to[first].astype(np.int64)), pa.array(packs, pa.binary())], ["prefix", "fps"])

    return send


class Forest:
    """Connected sets over 0..n-1; edges are added by the array."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.root[a], self.root[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.root, np.maximum(x, y), np.minimum(x, y))
            while (up := self.root[self.root]).tobytes() != self.root.tobytes():
                self.root = up


def unfold(fps: np.ndarray, left: np.ndarray, owners: np.ndarray, bits: int, distance: int, all_fps: np.ndarray, forest: Forest, most: int) -> None:
    """Meet on the variants that share the leading 64 - ``bits`` bits; ``left``: flips still open."""
    flips = masks_of(bits, int(left.max(initial=0)))
    n = sum(int((left == r).sum()) * len(f) for r, f in enumerate(flips))
    if n > most and bits > 1 and len(fps) > 1:
        bit = (fps >> np.uint64(bits - 1)) & np.uint64(1)
        for side in (0, 1):
            rest = left - (bit != side)
            on = rest >= 0
            unfold(fps[on], rest[on], owners[on], bits - 1, distance, all_fps, forest, most)
        return
    low = np.uint64((1 << bits) - 1)
    keys, whose = [], []
    for r, f in enumerate(flips):
        on = left == r
        keys.append(((fps[on] & low)[:, None] ^ f).ravel())
        whose.append(np.repeat(owners[on], len(f)))
    key, who = np.concatenate(keys), np.concatenate(whose)
    order = np.argsort(key)
    key, who = key[order], who[order]
    same = key[1:] == key[:-1]
    a, b = who[:-1][same], who[1:][same]
    near = np.bitwise_count(all_fps[a] ^ all_fps[b]) <= distance
    forest.add(a[near], b[near])


MASKS: dict[tuple[int, int], list[np.ndarray]] = {}


def masks_of(bits: int, most: int) -> list[np.ndarray]:
    if (bits, most) not in MASKS:
        MASKS[bits, most] = masks(bits, most)
    return MASKS[bits, most]


def prefix_links(prefix: int, fps: np.ndarray, p: int, distance: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links that meet in one prefix: (smallest member, member)."""
    fps = np.unique(fps)
    left = distance // 2 - np.bitwise_count((fps >> np.uint64(64 - p)) ^ np.uint64(prefix)).astype(np.int64)
    forest = Forest(len(fps))
    unfold(fps, left, np.arange(len(fps)), 64 - p, distance, fps, forest, most)
    linked = np.flatnonzero(forest.root != np.arange(len(fps)))
    signed = fps.view(np.int64)
    return signed[forest.root[linked]], signed[linked]


def meet(p: int, distance: int, most: int = 1 << 21):
    """Partitions hold whole prefixes in order; each is unfolded when its last row has come."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done() -> pa.RecordBatch:
            a, b = prefix_links(now, np.frombuffer(b"".join(held), np.uint64), p, distance, most)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        now, held = None, []
        for batch in batches:
            for prefix, fps in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if prefix != now and held:
                    yield done()
                    held = []
                now = prefix
                held.append(fps)
        if held:
            yield done()

    return link


def fingerprint_links(fps: DataFrame, distance: int) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs within ``distance`` bits.

    ``fps``: one long column of distinct fingerprints.
    """
    if distance % 2:
        raise ValueError("an even distance has a middle")
    n, radius = fps.count(), distance // 2
    ball = len(masks(64, radius)[-1])
    p = min(32, max(6, (n * ball >> 20).bit_length()))
    sent = fps.mapInArrow(to_prefixes(p, radius), "prefix long, fps binary")
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return sent.repartition(parts, "prefix").sortWithinPartitions("prefix").mapInArrow(meet(p, distance), "a long, b long")


def component_firsts(keyed: DataFrame, distance: int) -> DataFrame:
    """(salt, fp, first): for each salted fingerprint the first document of its component.

    ``keyed`` has salt, fp and ``this`` (a struct that orders documents).
    """
    part = saved(keyed.groupBy("salt", "fp").agg(F.min("this").alias("first")), "simhash-part")
    whole = saved(part.groupBy("fp").agg(F.min("first").alias("first")), "simhash-fps")
    roots = components(fingerprint_links(whole.select("fp"), distance))
    named = whole.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    named = saved(named.select("fp", "first", F.coalesce("root", "fp").alias("root")), "simhash-roots")
    best = named.groupBy("root").agg(F.min("first").alias("first"))
    return hand_down(named.select("fp", "root").join(best, "root").drop("root"), ["fp"], part)


def keyed_rows(docs: DataFrame, shingle: int, id_col: str, text_col: str, *keep) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    rows = docs.select(*keep, F.col(id_col).alias("doc_id"), fingerprints(shingle)(text).alias("fp"), F.monotonically_increasing_id().alias("row"))
    rows = rows.withColumn("salt", salt_of(docs.sparkSession, F.col("row")))
    return saved(rows.withColumn("this", F.struct(F.isnull("doc_id").alias("none"), "doc_id", "row")), "simhash-docs")


def simhash_groups(docs: DataFrame, shingle: int = 4, distance: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id.

    Words are split at white space, A-Z lower-cased; shorter texts than a shingle
    are one shingle, texts without words (null, empty) have fingerprint zero, which
    links like any other.  component_id is the smallest doc_id reachable over links
    of at most ``distance`` bits; a null doc_id counts last, so it is null only
    where all of a component's are.  Repeated rows each get a row.  An empty table
    gives an empty result; other columns are ignored.
    """
    keyed = keyed_rows(docs, shingle, id_col, text_col)
    out = keyed.join(component_firsts(keyed, distance), ["salt", "fp"])
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("first.doc_id").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, shingle: int = 4, distance: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, that come first (smallest doc_id, null last) in their component.

    Exactly one row of each component stays, also where rows are repeated whole.
    """
    keyed = keyed_rows(docs, shingle, id_col, text_col, F.struct("*").alias("doc"))
    first = component_firsts(keyed, distance).select("salt", "fp", F.col("first.row").alias("row"))
    return keyed.join(first, ["salt", "fp", "row"], "left_semi").select("doc.*")
