"""Hard negatives by a vertical scan of columnar vectors.

A batch of rows is turned into one column for each dimension.  An anchor reads these
dimensions in the falling order of its own components; what the unread ones can still add,
at least and at most, bounds each row's score, and rows that can't matter any more leave the
anchor's bitmap.  Two scans run: the first finds each anchor's best rows of its label, the
second the best rows of other labels inside the windows that those positives open.

Work is dealt by (anchor block, row group).  A task streams the batches of its rows past one
block of anchors, so it holds that block, one batch of rows and the best few rows so far.

Edge cases: rows with a null label, a null vector, or a null or non-finite component take no
part; vectors of different lengths end in zeros; null ids are rows but never anchors, and come
last among ties; repeated rows are rows of their own, so a row is not its own positive but its
copy is.  Ties go to the smaller id.  An anchor without positives, or a window without rows, has
no result.  An empty table gives an empty result.  Components beyond 2^45 count as
that; scores beyond 64 bits are compared exactly and come back as the nearest 64-bit number.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelkit.llm.common import materialize

#: Anchors of a block, and row groups that each anchor block meets.
BLOCK_ANCHORS, GROUPS = 2048, 24
#: Dimensions read between two looks at the bounds.
STRIDE = 8
NO_ID = (1 << 63) - 1
LARGEST = 2.0**53
SCORES = "array<decimal(38,0)>"
FOUND = "anchor long, anchor_id long, slot int, score decimal(38,0), vec_id long"
FOUND_TYPES = (pa.int64(), pa.int64(), pa.int32(), pa.decimal128(38, 0), pa.int64())


def eligible(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, embedding) of rows that take part; every seventh id has its label moved."""
    moved = F.when(F.coalesce(F.col("vec_id") % 7 == 0, F.lit(False)), (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    # a null or non-finite component makes the test null or false
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where("label is not null and embedding is not null").where(finite).select(
        F.col("vec_id").cast("long").alias("vec_id"), moved.alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))


def _whole(flat: np.ndarray) -> np.ndarray:
    """floor(256 x), at most 2^53 either way."""
    return np.clip(np.floor(flat * 256.0), -LARGEST, LARGEST).astype(np.int64)


class Rows:
    """A batch of rows as numpy: ``columns[d]`` is dimension d of all rows."""

    def __init__(self, batch: pa.RecordBatch):
        lists = batch["embedding"]
        size = np.diff(lists.offsets.to_numpy())
        self.n, self.dims = batch.num_rows, int(size.max(initial=0))
        table = np.zeros((self.n, self.dims))
        table[np.arange(self.dims) < size[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
        self.row, self.labels = batch["row"].to_numpy(), batch["label"].to_numpy()
        self.ids = batch["vec_id"].fill_null(NO_ID).to_numpy()
        self.columns = _whole(np.ascontiguousarray(table.T).ravel()).reshape(self.dims, self.n)
        self.least, self.most = self.columns.min(axis=1), self.columns.max(axis=1)
        self.largest = [max(abs(int(a)), abs(int(b))) for a, b in zip(self.least, self.most)]


class Scan:
    """Partial scores of one anchor over the rows of a block that its bitmap still has."""

    def __init__(self, anchor: np.ndarray, rows: Rows, alive: np.ndarray):
        dims = min(len(anchor), rows.dims)
        fits = sum(abs(int(a)) * m for a, m in zip(anchor[:dims], rows.largest)) < 1 << 62
        self.kind = np.int64 if fits else object
        self.anchor, self.rows = anchor[:dims].astype(self.kind), rows
        self.order = np.argsort(-np.abs(self.anchor), kind="stable")
        a, lo, hi = self.anchor[self.order], rows.least[:dims].astype(self.kind)[self.order], rows.most[:dims].astype(self.kind)[self.order]
        # what the dimensions from k on can add: suffix sums of each one's least and most
        zero = np.zeros(1, self.kind)
        self.floor = np.append(zero, np.cumsum(np.minimum(a * lo, a * hi)[::-1]))[::-1]
        self.ceiling = np.append(zero, np.cumsum(np.maximum(a * lo, a * hi)[::-1]))[::-1]
        self.alive, self.read = np.flatnonzero(alive), 0
        self.score = np.zeros(len(self.alive), self.kind)

    @property
    def done(self) -> bool:
        return self.read == len(self.order) or not len(self.alive)

    def step(self) -> tuple[np.ndarray, np.ndarray]:
        """Reads some dimensions more; returns each row's least and greatest possible score."""
        every = len(self.alive) == self.rows.n
        for d in self.order[self.read : self.read + STRIDE]:
            column = self.rows.columns[d]
            self.score += self.anchor[d] * (column if every else column[self.alive]).astype(self.kind, copy=False)
        self.read = min(self.read + STRIDE, len(self.order))
        return self.score + self.floor[self.read], self.score + self.ceiling[self.read]

    def keep(self, which: np.ndarray) -> None:
        if not which.all():
            self.alive, self.score = self.alive[which], self.score[which]


def _kth(values: np.ndarray, k: int):
    """The k-th greatest value, None if there are fewer."""
    return np.partition(values, len(values) - k)[len(values) - k] if len(values) >= k else None


def _best(scan: Scan, k: int, found: list) -> list:
    """``found``, up to k (score, -id) in a heap, with the rows of the scan that belong to it."""
    while not scan.done:
        low, high = scan.step()
        floor = _kth(low, k)
        if len(found) == k:
            floor = found[0][0] if floor is None else max(floor, found[0][0])
        if floor is not None:
            scan.keep(high >= floor)
    return _merge(found, scan.score, scan.rows.ids[scan.alive], k)


def _merge(found: list, score: np.ndarray, ids: np.ndarray, k: int) -> list:
    if len(score) > k:
        # only what may be among the k best, ties included
        top = score >= _kth(score, k)
        score, ids = score[top], ids[top]
        if len(score) > k:
            top = np.lexsort((ids, -score))[:k]
            score, ids = score[top], ids[top]
    for s, i in zip(score.tolist(), ids.tolist()):
        if len(found) < k:
            heapq.heappush(found, (s, -i))
        elif (s, -i) > found[0]:
            heapq.heapreplace(found, (s, -i))
    return found


def _windows(scan: Scan, windows: list, k: int, found: list) -> list:
    """For each (low, high) the k best scores inside it; ``found`` holds a heap for each."""
    while not scan.done:
        low, high = scan.step()
        wanted = np.zeros(len(low), bool)
        for (first, last), heap in zip(windows, found):
            may = (high >= first) & (low <= last)
            # rows that lie inside for certain make a floor for the k best
            inside = (low >= first) & (high <= last)
            floor = _kth(low[inside], k)
            if len(heap) == k:
                floor = heap[0][0] if floor is None else max(floor, heap[0][0])
            if floor is not None:
                may &= high >= floor
            wanted |= may
        scan.keep(wanted)
    ids = scan.rows.ids[scan.alive]
    for slot, (first, last) in enumerate(windows):
        inside = (scan.score >= first) & (scan.score <= last)
        _merge(found[slot], scan.score[inside], ids[inside], k)
    return found


class Task:
    """The anchors of a (anchor block, row group), and the best rows of each so far."""

    def __init__(self, k: int, share: tuple[int, int] | None):
        self.k, self.share, self.anchors, self.found = k, share, [], []

    def add(self, batch: pa.RecordBatch) -> None:
        for row in batch.to_pylist():
            windows = None
            if self.share:
                # whole numbers n with low * s <= 100 * n <= high * s
                low, high = self.share
                windows = [(-(-low * int(s) // 100), high * int(s) // 100) for s in row["scores"]]
            self.anchors.append((row["row"], row["vec_id"], row["label"], _whole(np.array(row["embedding"], float)), windows))
            self.found.append([[] for _ in windows] if self.share else [[]])

    def scan(self, rows: Rows) -> None:
        for (row, _, label, vector, windows), heaps in zip(self.anchors, self.found):
            same = rows.labels == label
            if self.share:
                _windows(Scan(vector, rows, ~same), windows, self.k, heaps)
            else:
                _best(Scan(vector, rows, same & (rows.row != row)), self.k, heaps[0])

    def results(self) -> pa.RecordBatch:
        out = [(a[0], a[1], slot, Decimal(s), None if i == -NO_ID else -i) for a, heaps in zip(self.anchors, self.found) for slot, heap in enumerate(heaps) for s, i in heap]
        columns = list(zip(*out)) or [()] * len(FOUND_TYPES)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, FOUND_TYPES)], names=["anchor", "anchor_id", "slot", "score", "vec_id"])


def _scanner(k: int, share: tuple[int, int] | None):
    """Streams rows sorted by (anchor block, group, kind): the anchors first, then the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, task = None, Task(k, share)
        for batch in batches:
            key = np.stack([batch[c].to_numpy() for c in ("anchors", "grp", "kind")])
            cuts = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
            for start, stop in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                if start == stop:
                    continue
                anchors, grp, kind = key[:, start].tolist()
                if (anchors, grp) != now:
                    yield task.results()
                    now, task = (anchors, grp), Task(k, share)
                some = batch.slice(start, stop - start)
                if kind == 0:
                    task.add(some)
                elif task.anchors:
                    task.scan(Rows(some))
        yield task.results()

    return run


def _scan(rows: DataFrame, anchors: DataFrame, n_anchors: int, k: int, share: tuple[int, int] | None = None) -> DataFrame:
    """FOUND rows with a rank: for each anchor and slot the best k of each row group, then of all.

    With ``share`` an anchor has a slot for each of its scores, the window of percentages of it.
    """
    n_blocks = max(1, -(-n_anchors // BLOCK_ANCHORS))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    part = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    data = ["row", "vec_id", "label", "embedding"]
    left = anchors.select(part(n_blocks).alias("anchors"), each(GROUPS).alias("grp"), F.lit(0).alias("kind"), *data, (F.col("scores") if share else F.lit(None).cast(SCORES)).alias("scores"))
    right = rows.select(each(n_blocks).alias("anchors"), part(GROUPS).alias("grp"), F.lit(1).alias("kind"), *data, F.lit(None).cast(SCORES).alias("scores"))
    dealt = left.unionByName(right).repartition(n_blocks * GROUPS, "anchors", "grp").sortWithinPartitions("anchors", "grp", "kind")
    found = dealt.mapInArrow(_scanner(k, share), FOUND)
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows whose id ``every`` divides.  A negative's score lies from ``low`` to
    ``high`` percent of its positive's.
    """
    # stored, so that a row's number names it from here on
    rows = materialize(eligible(vectors).withColumn("row", F.monotonically_increasing_id()), "vectors")
    anchors = rows.where(F.col("vec_id") % every == 0)
    n_anchors = anchors.count()
    best = materialize(_scan(rows, anchors, n_anchors, positives), "positives")
    scores = best.groupBy(F.col("anchor").alias("row")).agg(F.sort_array(F.collect_list(F.struct("rank", "score"))).alias("best"))
    asked = anchors.join(scores.select("row", F.col("best.score").alias("scores")), "row")
    found = _scan(rows, asked, n_anchors, negatives, (low, high))
    score = lambda c: F.expr(f"cast(least(greatest({c}, -9223372036854775808BD), 9223372036854775807BD) as long)")
    kept = best.select("anchor", "anchor_id", (F.col("rank") - 1).alias("slot"), F.col("vec_id").alias("positive_id"), score("score").alias("positive_score"))
    found = found.select("anchor", "slot", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), score("score").alias("negative_score"))
    return kept.join(found, ["anchor", "slot"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
