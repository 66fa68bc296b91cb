"""Token-id files: frequency-ranked ids in a byte-aligned code with separate control bytes.

Writing takes three steps.  Texts are encoded once, where they are read, and kept as plain
ids.  Ids are counted over all of them and ranked, the most frequent first.  Then the
documents are dealt by ranges of ``doc_id`` to *shards*, sorted, and runs of them become
*blocks*: each rank takes one to four data bytes, and a control byte holds the lengths of
four ranks, so frequent ids take a byte.  Control and data bytes are separate columns of a
Parquet dataset with one file for each shard.  Files in the order of their names, blocks in
a file and documents in a block ascend by ``doc_id``.  The ranking is written beside the
blocks, so the files explain themselves.  Reading decodes whole blocks with numpy table
lookups.

A shard is written as a stream of blocks, so its size is no matter of memory.  Rows of one
id are dealt to several shards if they are many: ranges are over (id, hash of the ids, place
in the plain ids), and that is also their order in the files.

Edge cases: null text encodes as empty (just the end id); null ids come last; documents
with equal ids follow each other in the order of a hash of their token ids; other columns
are ignored; an empty table gives an empty dataset.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelkit.llm.common import discard, materialize, new_path
from panelkit.llm.encoders import encoder, text_groups

ROWS_PER_SHARD = 8192
#: More documents than fill so many shards make shards larger, not more.
MAX_SHARDS = 100_000
BLOCK_IDS = 1 << 18
_BLOCK_SCHEMA = "shard long, block int, doc_ids array<bigint>, lengths array<int>, control binary, data binary"
_BLOCK_ARROW = pa.schema([("shard", pa.int64()), ("block", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("control", pa.binary()), ("data", pa.binary())])

#: For each control byte, the lengths of its four values.
_LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.int64) + 1


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of unsigned 32-bit values."""
    v = values.astype("<u4")
    size = 1 + (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    code = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    code[: len(v)] = size - 1
    control = code[0::4] | code[1::4] << 2 | code[2::4] << 4 | code[3::4] << 6
    octets = v.view(np.uint8).reshape(-1, 4)
    used = np.arange(4) < size[:, None]
    return control.tobytes(), octets[used].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` values that :func:`pack` coded; raises ValueError if the bytes don't fit."""
    size = _LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    octets = np.frombuffer(data + b"\0\0\0", np.uint8)
    end = np.cumsum(size)
    if len(size) != n or (end[-1] if n else 0) != len(data):
        raise ValueError("control bytes and data bytes don't belong together")
    start = end - size
    out = octets[start].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(size > k)
        if len(more):
            out[more] |= octets[start[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def _encode(path: str, end_id: int, kind: str):
    def run(batches):
        enc, end, nth = encoder(path), np.array([end_id], kind).tobytes(), 0
        for batch in batches:
            for doc_ids, texts in text_groups(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                ids = [np.frombuffer(b, "<u4").astype(kind).tobytes() + end for b in enc.encode(texts)]
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(range(nth, nth + len(ids)), pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "nth", "ids"])
                nth += len(ids)

    return run


def _count_ids(kind: str):
    def run(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            for ids in batch["ids"]:
                found = np.bincount(np.frombuffer(ids.as_buffer(), kind))
                if len(found) > len(total):
                    found, total = total, found.astype(np.int64)
                total[: len(found)] += found
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["id", "n"])

    return run


def _blocks(rank_of: np.ndarray, kind: str, block_ids: int):
    def run(batches):
        shard, rows, held, block = TaskContext.get().partitionId(), [], 0, 0

        def close():
            doc_ids, ids = zip(*rows)
            lengths = [len(i) for i in ids]
            control, data = pack(rank_of[np.concatenate(ids)])
            row = [[shard], [block], [list(doc_ids)], [lengths], [control], [data]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, _BLOCK_ARROW.types)], schema=_BLOCK_ARROW)

        for batch in batches:
            for doc_id, ids in zip(batch["doc_id"].to_pylist(), batch["ids"]):
                if rows and held >= block_ids:
                    yield close()
                    block, rows, held = block + 1, [], 0
                rows.append((doc_id, np.frombuffer(ids.as_buffer(), kind)))
                held += len(rows[-1][1])
        if rows:
            yield close()

    return run


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int, rows_per_shard: int = ROWS_PER_SHARD, block_ids: int = BLOCK_IDS) -> None:
    """Encode ``docs`` with the tokenizer file and write blocks and ranking under ``path``."""
    spark = docs.sparkSession
    kind = "<u2" if max(end_id + 1, encoder(tokenizer).tokenizer.get_vocab_size()) <= 1 << 16 else "<u4"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    plain = materialize(rows.mapInArrow(_encode(tokenizer, end_id, kind), "doc_id long, nth long, ids binary"), "plain-ids")
    counts = plain.select("ids").mapInArrow(_count_ids(kind), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    # at most one row for each id of the vocabulary, whatever the input
    found = sorted(counts.collect(), key=lambda r: (-r["n"], r["id"]))
    ranking = spark.createDataFrame([(k, r["id"], r["n"]) for k, r in enumerate(found)], "rank long, id long, n long")
    ranking.coalesce(1).write.parquet(f"{path}/ranking")
    rank_of = np.zeros(max([r["id"] for r in found], default=0) + 1, np.uint32)
    for k, r in enumerate(found):
        rank_of[r["id"]] = k
    shards = min(max(1, -(-plain.count() // rows_per_shard)), MAX_SHARDS)
    order = [F.asc_nulls_last("doc_id"), F.col("key"), F.col("nth")]
    sharded = plain.withColumn("key", F.xxhash64("ids")).repartitionByRange(shards, *order).sortWithinPartitions(*order)
    sharded.select("doc_id", "ids").mapInArrow(_blocks(rank_of, kind, block_ids), _BLOCK_SCHEMA).write.parquet(f"{path}/blocks")
    discard(plain)


def _decoded(spark: SparkSession, path: str, make, schema: str) -> DataFrame:
    """Rows that ``make(shard, block, doc_ids, ids of each)`` gives as a batch for every block of the files."""
    ranking = spark.read.parquet(f"{path}/ranking").orderBy("rank").collect()
    id_of = np.array([r["id"] for r in ranking] or [0], "<u4")

    def decode(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                shard, block, doc_ids, lengths, control, data = (batch[c][k].as_py() for c in _BLOCK_ARROW.names)
                ids = id_of[unpack(control, data, sum(lengths))].tobytes()
                ends = (4 * np.cumsum(lengths)).tolist()
                yield make(shard, block, doc_ids, [ids[a:b] for a, b in zip([0, *ends], ends)])

    return spark.read.schema(_BLOCK_SCHEMA).parquet(f"{path}/blocks").mapInArrow(decode, schema)


def _places(shard: int, block: int, doc_ids: list) -> list[pa.Array]:
    size = len(doc_ids)
    return [pa.array([shard] * size, pa.int64()), pa.array([block] * size, pa.int32()), pa.array(range(size), pa.int32()), pa.array(doc_ids, pa.int64())]


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(shard, block, nth, doc_id, ids): documents of the files; ids little-endian unsigned 32-bit."""

    def make(shard, block, doc_ids, ids):
        return pa.RecordBatch.from_arrays([*_places(shard, block, doc_ids), pa.array(ids, pa.binary())], names=["shard", "block", "nth", "doc_id", "ids"])

    return _decoded(spark, path, make, "shard long, block int, nth int, doc_id long, ids binary")


def stored_digest(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document in the files under ``path``.

    ``start`` comes from prefix sums in the order of the files: over shards (one row each)
    and inside a shard.
    """

    def make(shard, block, doc_ids, ids):
        digest = [pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(list(map(zlib.crc32, ids)), pa.int64())]
        return pa.RecordBatch.from_arrays([*_places(shard, block, doc_ids), *digest], names=["shard", "block", "nth", "doc_id", "n_tokens", "ids_crc32"])

    digest = materialize(_decoded(spark, path, make, "shard long, block int, nth int, doc_id long, n_tokens long, ids_crc32 long"), "digest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    # MAX_SHARDS rows at most
    shards = digest.groupBy("shard").agg(F.sum("n_tokens").alias("t"))
    shards = shards.select("shard", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("shard_start"))
    inside = Window.partitionBy("shard").orderBy("block", "nth").rowsBetween(Window.unboundedPreceding, -1)
    placed = digest.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return placed.join(F.broadcast(shards), "shard").select("doc_id", (F.col("shard_start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def encode_to_files(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Write the files in the shared folder, read them back and describe each document."""
    spark = docs.sparkSession
    path = new_path(spark, "token-ids")
    write_ids(docs, path, tokenizer, end_id)
    return stored_digest(spark, path)
