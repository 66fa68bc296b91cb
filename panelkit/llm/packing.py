"""Best-fit packing of token pieces by linear grouping.

Documents longer than the capacity are cut; every other document is one item.  What the
plan needs of all items is how many there are of each length, at most ``capacity``
numbers.  On these the driver packs:

1. Large lengths are put in groups of equal cardinality, and each is rounded up to the
   longest of its group, which leaves few sizes.
2. Configurations (how many items of each size share a sequence) are optimised on the few
   sizes: the largest size left, filled up as far as a knapsack over the others can.  A
   configuration is used as often as the counts allow.
3. Actual lengths take the places of the rounded ones, longest first, which frees room.
4. Small items go, longest first, to the sequence with the least room that holds them.

The plan is a list of intervals of item ranks within a length.  Its size depends on the
number of lengths, not on the number of items.  Spark ranks the items of a length in two
levels, so a length that many items share is spread over tasks, and places each item by
its interval.

Edge cases: null text is an empty document, whose only token is the end id; rows are
packed one by one, so null or repeated ids are separate items; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelkit.llm.common import by_size, materialize
from panelkit.llm.encoders import encoder, text_groups

CAPACITY = 1024
GROUPS = 192
LARGE_SHARE = 8
#: Groups in which the items of a length are ranked: at least this many, and more for more items.
SALTS, ITEMS_PER_SALT, MOST_SALTS = 256, 1_000_000, 65_536
#: A plan of more rows, which the number of lengths should not allow, is joined without a broadcast.
BROADCAST_PLAN = 200_000
#: Bytes of text that are encoded at a time.
GROUP_BYTES = 1 << 21
_PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long"


def _cut(path: str, end_id: int, capacity: int):
    def run(batches):
        enc, end = encoder(path), np.uint32(end_id).tobytes()
        for batch in by_size(batches, "text", GROUP_BYTES):
            for doc_ids, texts in text_groups(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), GROUP_BYTES):
                out = [[], [], [], [], []]
                for doc_id, ids in zip(doc_ids, enc.encode(texts)):
                    ids += end
                    n = len(ids) // 4
                    starts = [0, *range(n % capacity or capacity, n, capacity)]
                    for k, (a, b) in enumerate(zip(starts, [*starts[1:], n])):
                        for column, value in zip(out, (doc_id, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b]))):
                            column.append(value)
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def cut_documents(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): documents' ids with the end id, in pieces.

    Only documents longer than the capacity are cut; all their pieces but the first are
    full.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_cut(tokenizer, end_id, capacity), _PIECES)


class _Items:
    """Hands out item ranks of each length as runs [first, first + n)."""

    def __init__(self, counts: dict[int, int]):
        self.left, self.next = dict(counts), Counter()

    def take(self, length: int, n: int) -> int:
        first = self.next[length]
        self.next[length] += n
        self.left[length] -= n
        return first


def _best_fill(room: int, sizes: list[int], limit: list[int]) -> dict[int, int]:
    """Sizes (index: copies) that fill ``room`` as far as possible: a bounded knapsack."""
    reach = np.zeros(room + 1, bool)
    reach[0] = True
    layers = []
    for k, (s, most) in enumerate(zip(sizes, limit)):
        layers.append(reach)
        if s <= room and most:
            reach = reach.copy()
            for _ in range(min(most, room // s)):
                new = reach.copy()
                new[s:] |= reach[:-s]
                if (new == reach).all():
                    break
                reach = new
        if reach[room]:
            layers.append(reach)
            break
    else:
        layers.append(reach)
    at, fill = int(np.flatnonzero(layers[-1])[-1]), {}
    for k in range(len(layers) - 2, -1, -1):
        while not layers[k][at]:
            at -= sizes[k]
            fill[k] = fill.get(k, 0) + 1
    return fill


def plan_packing(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, large_share: int = LARGE_SHARE) -> tuple[list[tuple], int]:
    """([(length, first_rank, n_items, first_sequence, items_per_sequence, offset)], sequences).

    ``counts`` maps lengths of 1 to ``capacity`` to numbers of items.
    """
    items, plan, sequences = _Items({k: n for k, n in counts.items() if n}), [], 0
    rooms: dict[int, list[tuple[int, int]]] = {}  # room left: runs of sequences (first, n)
    if items.left.get(capacity):
        n = items.left[capacity]
        plan.append((capacity, items.take(capacity, n), n, 0, 1, 0))
        sequences = n
    large = sorted((k for k in items.left if capacity > k > capacity // large_share and items.left[k]), reverse=True)
    total = sum(items.left[k] for k in large)
    # 1. groups of equal cardinality; a length may be in two of them
    sizes: list[int] = []
    members: list[list[tuple[int, int]]] = []
    limit, held = -(-total // groups), 0
    for length in large:
        n = items.left[length]
        while n:
            if not members or held == limit:
                sizes.append(length)
                members.append([])
                held = 0
            some = min(n, limit - held)
            members[-1].append((length, some))
            held += some
            n -= some
    merged: dict[int, list] = {}
    for s, m in zip(sizes, members):
        merged.setdefault(s, []).extend(m)
    sizes = sorted(merged, reverse=True)
    queue = [merged[s] for s in sizes]
    left = [sum(n for _, n in q) for q in queue]
    # 2. configurations on the few sizes; 3. actual lengths in their places
    for k, size in enumerate(sizes):
        while left[k]:
            limit_of = [left[j] - (j == k) for j in range(k, len(sizes))]
            fill = _best_fill(capacity - size, sizes[k:], limit_of)
            config = Counter({k: 1})
            for j, n in fill.items():
                config[k + j] += n
            times = min(left[j] // n for j, n in config.items())
            slots = [j for j, n in sorted(config.items()) for _ in range(n)]
            for j, n in config.items():
                left[j] -= n * times
            while times:
                # a run of sequences in which every place has one actual length
                need = Counter(slots)
                run = min(min(queue[j][0][1] // n if queue[j][0][1] >= n else 1 for j, n in need.items()), times)
                offset = 0
                for j in slots:
                    length, have = queue[j][0]
                    if have < run:
                        raise AssertionError("a run outlasts its items")
                    plan.append((length, items.take(length, run), run, sequences, 1, offset))
                    offset += length
                    queue[j][0] = (length, have - run)
                    if have == run:
                        queue[j].pop(0)
                if offset < capacity:
                    rooms.setdefault(capacity - offset, []).append((sequences, run))
                sequences += run
                times -= run
    # 4. small items: the sequence with the least room that holds one takes as many as it can
    free = sorted(rooms)
    for length in sorted((k for k, n in items.left.items() if n), reverse=True):
        while items.left[length]:
            at = bisect.bisect_left(free, length)
            if at == len(free):
                n = -(-items.left[length] // (capacity // length))
                rooms.setdefault(capacity, []).append((sequences, n))
                bisect.insort(free, capacity)
                sequences += n
                continue
            room = free[at]
            first, n = rooms[room].pop()
            each = min(room // length, items.left[length])
            used = min(n, items.left[length] // each)
            if used < n:
                rooms[room].append((first + used, n - used))
            if not rooms[room]:
                del rooms[room]
                free.pop(at)
            plan.append((length, items.take(length, used * each), used * each, first, each, capacity - room))
            rest = room - each * length
            if rest:
                if rest not in rooms:
                    bisect.insort(free, rest)
                rooms.setdefault(rest, []).append((first, used))
    return plan, sequences


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; it is read several times, so pass a stored table."""
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan, _ = plan_packing(counts, capacity, groups)
    salts = min(max(SALTS, -(-sum(counts.values()) // ITEMS_PER_SALT)), MOST_SALTS)
    salted = pieces.withColumn("__salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    # a row for each length and salt; the join finds the pieces where the window has put them
    before = Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = salted.groupBy("length", "__salt").agg(F.count(F.lit(1)).alias("__n"))
    bases = bases.select("length", "__salt", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    within = Window.partitionBy("length", "__salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("__nth", F.row_number().over(within) - 1).join(bases, ["length", "__salt"])
    ranked = ranked.withColumn("__rank", F.col("__base") + F.col("__nth"))
    # the plan's size is bounded by the number of lengths
    slots = spark.createDataFrame(plan, "__length int, __first long, __n long, __sequence long, __each long, __offset long")
    if len(plan) <= BROADCAST_PLAN:
        slots = F.broadcast(slots)
    hit = (F.col("length") == F.col("__length")) & (F.col("__rank") >= F.col("__first")) & (F.col("__rank") < F.col("__first") + F.col("__n"))
    k = F.col("__rank") - F.col("__first")
    placed = ranked.join(slots, hit)
    return placed.select(
        *pieces.columns,
        (F.col("__sequence") + F.floor(k / F.col("__each"))).cast("long").alias("sequence_id"),
        (F.col("__offset") + (k % F.col("__each")) * F.col("length")).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """Cut and pack ``docs``; one row for each piece."""
    pieces = materialize(cut_documents(docs, tokenizer, end_id, capacity), "pieces", batch_bytes=GROUP_BYTES)
    packed = pack_pieces(pieces, capacity)
    return packed.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")
