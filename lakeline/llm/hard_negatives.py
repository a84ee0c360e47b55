"""Hard-negative mining over an inverted multi-index.

Vectors are split in two halves.  A codebook per half (k-means on a bounded sample of
rows) gives each row two codes; a pair of codes is a cell.  Rows are range-partitioned by
cell and written once: that is the index, and every row is in it.  A cell larger than a
partition goes over several.

A search takes anchors in blocks, each block against all index partitions.  Within a
partition the half score of an anchor with any row of a code is at most its product with
the code's centre plus its own length times the code's radius, the distance of the
farthest row.  Codes of both halves are sorted by that bound and a heap walks their pairs
by the sum, largest first (the multi-sequence order), so bounds only fall.  A cell is
scored where the bounds by its own radii meet a window that is still open; the walk ends
once the next sum is below what every window of the anchor still needs: its lower end, or
the score of its last place when it is full.  What a partition returns for a window is
therefore certified: it has no better row.  Cells that anchors reach in the same step are
scored together as a matrix product.

Two such searches make a block: the best rows of the anchor's own label (positives), then,
for the score window that each positive opens, the best rows of other labels.  A
partition returns at most ``k`` rows a window, so what is merged is small.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeline.llm.common import new_path, saved

ROWS = "id long, label long, vector binary, code1 int, code2 int, salt long"
FOUND = "anchor int, slot int, id long, score long"
LIMIT = 1 << 24  # components beyond are set to it, so that scores stay 64-bit numbers
PER_CELL = 256  # rows of a cell, about
SAMPLE = 8_192  # rows the codebooks are fitted on, about
ROUNDS = 8  # of k-means
PIECE = 2_048  # rows scored at a time
ANCHORS = 1_024  # anchors walked at a time within a task
PARTITION = 64 << 20  # bytes of vectors in an index partition, about
SLACK = 1e-6  # relative, for rounding in bounds
LAST = np.iinfo(np.int64).max  # stands for a null id: after all others


def quantised(vectors: pa.Array, width: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(which rows are usable, their components as floor(scale * x), padded with zeros to ``width``)."""
    sizes = np.array(vectors.value_lengths().fill_null(0), np.int64)
    flat = vectors.flatten()
    values = np.array(flat.cast(pa.float64()).fill_null(np.nan), np.float64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    bad = np.zeros(len(sizes), bool)
    bad[row[~np.isfinite(values)]] = True
    usable = ~bad & np.array(vectors.is_valid())
    out = np.zeros((len(sizes), width))
    keep = usable[row]
    place = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[row[keep], place[keep]] = np.clip(np.floor(np.clip(values[keep], -1e15, 1e15) * scale), -LIMIT, LIMIT)
    return usable, out[usable].astype(np.int32)


def codebook(sample: np.ndarray, k: int) -> np.ndarray:
    """k-means centres of the rows of ``sample``, from evenly spaced first ones."""
    if not len(sample):
        return np.zeros((1, sample.shape[1]))
    distinct = np.unique(sample, axis=0)
    centres = distinct[np.linspace(0, len(distinct) - 1, min(k, len(distinct))).astype(int)].astype(float)
    for _ in range(ROUNDS):
        code = nearest(sample, centres)
        count = np.bincount(code, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, code, sample)
        centres = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centres)
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(1) - 2 * (x.astype(float) @ centres.T), axis=1)


def encoder(width: int, scale: int, books: tuple[np.ndarray, np.ndarray]):
    """id, label, vector and salt -> index rows; unusable vectors go."""
    cut = books[0].shape[1]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            usable, x = quantised(batch.column(2), width, scale)
            codes = [nearest(part, book).astype(np.int32) for part, book in zip((x[:, :cut], x[:, cut:]), books)]
            raw = [row.tobytes() for row in x]
            kept = batch.filter(pa.array(usable))
            yield pa.RecordBatch.from_arrays(
                [kept.column(0), kept.column(1), pa.array(raw, pa.binary()), *map(pa.array, codes), kept.column(3)],
                ["id", "label", "vector", "code1", "code2", "salt"],
            )

    return encode


def build_index(rows: DataFrame, scale: int) -> tuple[DataFrame, int, int]:
    """(index rows, their number, components).  ``rows``: id, label, vector; none null but id."""
    spark = rows.sparkSession
    seen = rows.select(F.count(F.lit(1)), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
    n, width = seen[0], max(2, seen[1])
    k = max(1, min(256, ceil(sqrt(n / PER_CELL))))
    rows = rows.select("id", "label", "vector", F.xxhash64(F.lit(11), F.monotonically_increasing_id()).alias("salt"))
    some = rows.where(F.pmod("salt", F.lit(max(1, n))) < SAMPLE).select("vector").limit(2 * SAMPLE).toArrow()
    _, sample = quantised(some.column(0).combine_chunks(), width, scale)
    cut = (width + 1) // 2
    books = (codebook(sample[:, :cut], k), codebook(sample[:, cut:], k))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), ceil(n * width * 4 / PARTITION))
    coded = rows.mapInArrow(encoder(width, scale, books), ROWS)
    # The salt deals a cell that is larger than a partition over several.
    return saved(coded.repartitionByRange(parts, "code1", "code2", "salt"), "vector-index"), n, width


class Cells:
    """The rows of one index partition by cell, with the bounds of codes and cells."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, code1: np.ndarray, code2: np.ndarray):
        order = np.lexsort((ids, code2, code1))
        self.ids, self.labels, self.x = ids[order], labels[order], x[order]
        code1, code2 = code1[order], code2[order]
        first = np.flatnonzero(np.concatenate([[True], (np.diff(code1) != 0) | (np.diff(code2) != 0)]))
        self.ends = np.concatenate([first, [len(order)]])
        sizes = np.diff(self.ends)
        cut = (x.shape[1] + 1) // 2
        self.halves = (slice(0, cut), slice(cut, None))
        self.codes, self.centres, self.radii, self.cell_radii = [], [], [], []
        for code, half in zip((code1, code2), self.halves):
            names, place = np.unique(code, return_inverse=True)
            part = self.x[:, half].astype(float)
            total = np.zeros((len(names), part.shape[1]))
            np.add.at(total, place, part)
            centre = total / np.bincount(place)[:, None]  # the mean of what is here, never a far-off centre
            far = np.sqrt(((part - centre[place]) ** 2).sum(1))
            radius = np.zeros(len(names))
            np.maximum.at(radius, place, far)
            self.codes.append(place[first])
            self.centres.append(centre)
            self.radii.append(radius)
            self.cell_radii.append(np.maximum.reduceat(far, first))
        self.cell = {(int(a), int(b)): i for i, (a, b) in enumerate(zip(*self.codes))}
        self.sizes = sizes


class Block:
    """Anchors with the windows they look for: rows of their own label or of others.

    low and high: (anchors, slots) scores a row must lie between; own: label must agree.
    """

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, low: np.ndarray, high: np.ndarray, own: bool, k: int):
        self.ids, self.labels, self.x, self.low, self.high, self.own, self.k = ids, labels, x, low, high, own, k

    def pieces(self, cells: Cells) -> Iterator[tuple[np.ndarray, ...]]:
        """``search`` for some anchors at a time."""
        for begin in range(0, len(self.ids), ANCHORS):
            cut = slice(begin, begin + ANCHORS)
            some = Block(self.ids[cut], self.labels[cut], self.x[cut], self.low[cut], self.high[cut], self.own, self.k)
            anchor, *rest = some.search(cells)
            yield anchor + begin, *rest

    def search(self, cells: Cells) -> tuple[np.ndarray, ...]:
        """(anchor, slot, id, score) of the best k rows of each window in these cells."""
        n, slots = self.low.shape
        most = np.abs(self.x).max(initial=0) * float(np.abs(cells.x).max(initial=0)) * self.x.shape[1]
        kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64
        anchors, rows = self.x.astype(kind), cells.x.astype(kind)
        length = [np.sqrt((self.x[:, h].astype(float) ** 2).sum(1)) for h in cells.halves]
        dots = [self.x[:, h].astype(float) @ c.T for h, c in zip(cells.halves, cells.centres)]
        bounds = [d + q[:, None] * r for d, q, r in zip(dots, length, cells.radii)]
        middle = dots[0][:, cells.codes[0]] + dots[1][:, cells.codes[1]]
        reach = length[0][:, None] * cells.cell_radii[0] + length[1][:, None] * cells.cell_radii[1]
        slack = SLACK * (1 + length[0] + length[1])[:, None] * (1 + float(np.abs(rows).max(initial=0))) * self.x.shape[1]
        upper, lower = middle + reach + slack, middle - reach - slack
        order = [np.argsort(-b, axis=1, kind="stable") for b in bounds]
        falling = [np.take_along_axis(b, o, 1) + slack / 2 for b, o in zip(bounds, order)]
        walks = [Walk(falling[0][i], falling[1][i], order[0][i], order[1][i], cells.cell) for i in range(n)]
        need = self.low.astype(float).copy()  # what a window's next row must reach
        widest = np.where(self.low <= self.high, self.high, -np.inf).max(1)
        kept = Kept(n * slots, self.k)
        active = [i for i in range(n) if (self.low[i] <= self.high[i]).any()]
        while active:
            least, reached, still = need.min(1), {}, []
            for i in active:
                c = walks[i].next(least[i], upper[i], lower[i], widest[i])
                if c >= 0:
                    reached.setdefault(c, []).append(i)
                    still.append(i)
            active = still
            for c, some in reached.items():
                for begin in range(cells.ends[c], cells.ends[c + 1], PIECE):
                    end = min(begin + PIECE, cells.ends[c + 1])
                    self.score(cells, rows, anchors, np.array(some), begin, end, need, kept)
            touched = kept.settle()
            if len(touched):
                full = touched[kept.count[touched] == self.k]
                need.reshape(-1)[full] = np.maximum(need.reshape(-1)[full], kept.last(full))
        return kept.rows(slots)

    def score(self, cells, rows, anchors, some, begin, end, need, kept) -> None:
        scores = anchors[some] @ rows[begin:end].T
        same = self.labels[some][:, None] == cells.labels[begin:end]
        fits = same & (self.ids[some][:, None] != cells.ids[begin:end]) if self.own else ~same
        for slot in range(self.low.shape[1]):
            good = fits & (scores >= need[some, slot][:, None]) & (scores <= self.high[some, slot][:, None])
            a, b = np.nonzero(good)
            if len(a):
                kept.add(some[a] * self.low.shape[1] + slot, scores[a, b].astype(np.int64), cells.ids[begin + b])


class Walk:
    """Pairs of two falling lists by their sum, largest first: the multi-sequence heap."""

    def __init__(self, first: np.ndarray, second: np.ndarray, order1: np.ndarray, order2: np.ndarray, cell: dict):
        self.first, self.second, self.order = first.tolist(), second.tolist(), (order1.tolist(), order2.tolist())
        self.cell, self.heap = cell, [(-(self.first[0] + self.second[0]), 0, 0)]

    def next(self, least: float, upper: np.ndarray, lower: np.ndarray, widest: float) -> int:
        """The next cell that may hold a row between ``least`` and ``widest``; -1 when none can follow."""
        heap = self.heap
        while heap:
            if -heap[0][0] < least:
                self.heap = []
                return -1
            _, i, j = heapq.heappop(heap)
            if j + 1 < len(self.second):
                heapq.heappush(heap, (-(self.first[i] + self.second[j + 1]), i, j + 1))
            if j == 0 and i + 1 < len(self.first):
                heapq.heappush(heap, (-(self.first[i + 1] + self.second[0]), i + 1, 0))
            c = self.cell.get((self.order[0][i], self.order[1][j]), -1)
            if c >= 0 and upper[c] >= least and lower[c] <= widest:
                return c
        return -1


class Kept:
    """The best k (score down, id up) rows of each of many windows."""

    def __init__(self, windows: int, k: int):
        self.k, self.count = k, np.zeros(windows, np.int64)
        self.window, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))
        self.new: list[tuple[np.ndarray, ...]] = []
        self.floor = np.zeros(windows, np.int64)

    def add(self, window: np.ndarray, score: np.ndarray, id_: np.ndarray) -> None:
        if len(window) > 4 * self.k:  # of one piece only the best of each window can stay
            keep = self.best(window, score, id_)
            window, score, id_ = window[keep], score[keep], id_[keep]
        self.new.append((window, score, id_))

    def best(self, window: np.ndarray, score: np.ndarray, id_: np.ndarray) -> np.ndarray:
        order = np.lexsort((id_, -score, window))
        w = window[order]
        first = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
        place = np.arange(len(w)) - np.repeat(first, np.diff(np.concatenate([first, [len(w)]])))
        return order[place < self.k]

    def settle(self) -> np.ndarray:
        """Take in what was added; the windows it was added to."""
        if not self.new:
            return np.zeros(0, np.int64)
        touched = np.unique(np.concatenate([x[0] for x in self.new]))
        changed = np.zeros(len(self.count), bool)
        changed[touched] = True
        mine = changed[self.window]
        old = [x[mine] for x in (self.window, self.score, self.id)]
        rest = [x[~mine] for x in (self.window, self.score, self.id)]
        window, score, id_ = (np.concatenate([o, *(x[i] for x in self.new)]) for i, o in enumerate(old))
        keep = self.best(window, score, id_)
        window, score, id_ = window[keep], score[keep], id_[keep]
        self.count[touched] = np.bincount(window, minlength=len(self.count))[touched]
        last = np.flatnonzero(np.concatenate([window[1:] != window[:-1], [True]]))
        self.floor[window[last]] = score[last]
        self.window, self.score, self.id = (np.concatenate([r, x]) for r, x in zip(rest, (window, score, id_)))
        self.new = []
        return touched

    def last(self, windows: np.ndarray) -> np.ndarray:
        return self.floor[windows]

    def rows(self, slots: int) -> tuple[np.ndarray, ...]:
        return self.window // slots, self.window % slots, self.id, self.score


def searcher(block: Broadcast):
    """Search a partition for a broadcast block; its rows are gathered, then walked."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [unpacked(b) for b in batches if b.num_rows]
        if not parts:
            return
        cells = Cells(*(np.concatenate(x) for x in zip(*parts)))
        parts.clear()
        for anchor, slot, id_, score in block.value.pieces(cells):
            columns = [pa.array(anchor.astype(np.int32)), pa.array(slot.astype(np.int32)), pa.array(id_, mask=id_ == LAST), pa.array(score)]
            yield pa.RecordBatch.from_arrays(columns, ["anchor", "slot", "id", "score"])

    return search


def unpacked(batch) -> tuple[np.ndarray, ...]:
    """ids (null: last), labels, components and codes of index rows."""
    n = batch.num_rows
    x = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.int32).reshape(n, -1)
    ids = np.array(batch.column(0).fill_null(LAST), np.int64)
    return ids, np.array(batch.column(1), np.int64), x, np.array(batch.column(3), np.int64), np.array(batch.column(4), np.int64)


def best_of(index: DataFrame, block: Block) -> DataFrame:
    """anchor, slot, rank (from 1), id, score: the best k of each window over all partitions."""
    sent = index.sparkSession.sparkContext.broadcast(block)
    found = index.mapInArrow(searcher(sent), FOUND)
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= block.k)


def mine_block(index: DataFrame, anchors: pa.Table, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id and scores for one block of anchors."""
    spark = index.sparkSession
    ids, labels, x, _, _ = unpacked(anchors.combine_chunks().to_batches()[0])
    n, least, most = len(ids), np.iinfo(np.int64).min, np.iinfo(np.int64).max
    open_ = Block(ids, labels, x, np.full((n, 1), least), np.full((n, 1), most), True, positives)
    found = best_of(index, open_).select("anchor", "rank", "id", "score").toArrow()  # positives x block rows at most
    a, slot, score = (np.array(found.column(c), np.int64) for c in ("anchor", "rank", "score"))
    lows, highs = np.full((n, positives), most), np.full((n, positives), least)
    # low * score <= 100 * negative <= high * score, in whole numbers of any size
    lows[a, slot - 1] = [-(-low * int(s) // 100) for s in score]
    highs[a, slot - 1] = [high * int(s) // 100 for s in score]
    best = best_of(index, Block(ids, labels, x, lows, highs, False, negatives))
    pairs = pa.table({
        "anchor": pa.array(a.astype(np.int32)), "slot": pa.array((slot - 1).astype(np.int32)), "anchor_id": pa.array(ids[a]),
        "positive_id": found.column("id"), "positive_score": pa.array(score),
    })
    named = spark.createDataFrame(pairs, "anchor int, slot int, anchor_id long, positive_id long, positive_score long")
    return best.join(named, ["anchor", "slot"]).select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


def mine_hard_negatives(
    rows: DataFrame, is_anchor: Callable[[Column], Column], positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
    scale: int = 256, block: int = 16_384, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Scores are inner products of components floor(scale * x).  ``is_anchor`` tells anchors
    by id.  An anchor's positives are its best rows of the same label and another id; a
    positive's negatives are the anchor's best rows of other labels with ``low`` to ``high``
    hundredths of the positive's score.  Best: higher score, then smaller id, null last.

    Rows with a null label, a null vector or a null or non-finite component take no part.
    Shorter vectors count as filled up with zeros; a component is held within 2^24.  A null
    id is no anchor, but may be found.  Repeated rows are rows of their own: each repeated
    anchor has its own results, and rows with the anchor's own id are never its positives.
    No rows or no anchors give an empty result; other columns are ignored.

    ``block`` anchors (about that many, dealt by hash) are on the driver and broadcast at a
    time; a pass reads the index twice.  A task holds one index partition.
    """
    spark = rows.sparkSession
    label, vector = F.col(label_col).cast("long"), F.col(vector_col)
    used = rows.where(label.isNotNull() & vector.isNotNull())
    used = used.select(F.col(id_col).cast("long").alias("id"), label.alias("label"), vector.cast("array<double>").alias("vector"))
    index, _, _ = build_index(used, scale)
    anchors = index.where(F.col("id").isNotNull() & is_anchor(F.col("id")))
    n = anchors.count()
    blocks, path = max(1, ceil(n / block)), new_path(spark, "hard-negatives")
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not n:
        return spark.createDataFrame([], schema)
    for b in range(blocks):
        some = anchors.where(F.pmod(F.xxhash64("salt"), F.lit(blocks)) == b).toArrow()
        if some.num_rows:
            mine_block(index, some, positives, negatives, low, high).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)
