"""What Python makes of a batch is bounded by bytes, not by rows alone."""

from collections import Counter

import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F

from panelkit.llm import common, encoders, line_dedup, lm_score, near_dup, packing


def batch(texts):
    return pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], names=["doc_id", "text"])


def test_parts_by_size():
    texts = ["ab" * 40, None, "", "é" * 50, "x" * 1000, None, "y"]
    for limit in (1, 100, 150, 10**6):
        parts = list(common.by_size(iter([batch(texts), batch([]), batch([None])]), "text", limit))
        assert [t for p in parts for t in p["text"].to_pylist()] == [*texts, None]
        assert [k for p in parts for k in p["doc_id"].to_pylist()] == [*range(7), 0]
        assert all(sum(len((t or "").encode()) for t in p["text"].to_pylist()[1:]) <= limit for p in parts)
    assert len(list(common.by_size(iter([batch(texts)]), "text", 10**6))) == 1


def test_counting_holds_a_part_at_a_time(monkeypatch):
    held = []
    parted = common.by_size
    monkeypatch.setattr(lm_score, "by_size", lambda b, c: (held.append(p.num_rows) or p for p in parted(b, c, 1000)))
    found = Counter()
    for made in lm_score._count_words(iter([batch(["one Two two"] * 500)])):
        found.update(dict(zip(made["word"].to_pylist(), made["n"].to_pylist())))
    assert found == {b"one": 500, b"two": 1000} and max(held) < 100 and sum(held) == 500


def test_packing_holds_a_part_at_a_time(monkeypatch):
    texts = [f"some words of text {k}" for k in range(300)]
    cut = packing._cut(public_tokenizers.path("byte_bpe_50k.json"), 2, 1024)
    whole = [row for b in cut(iter([batch(texts)])) for row in b.to_pylist()]
    seen, parted = [], packing.by_size
    monkeypatch.setattr(packing, "GROUP_BYTES", 500)
    monkeypatch.setattr(packing, "by_size", lambda b, c, n: (seen.append(p.num_rows) or p for p in parted(b, c, n)))
    assert [row for b in cut(iter([batch(texts)])) for row in b.to_pylist()] == whole
    assert sum(seen) == 300 and max(seen) < 40


def test_shingles_written_out(spark):
    """Those written out and those of the lambda function have the same hashes."""
    n = line_dedup.UNROLLED
    sizes = [1, 4, 5, 6, n + 3, n + 4, n + 5, 3 * n]
    df = spark.createDataFrame([(k, [k * 1000 + x for x in range(k)]) for k in sizes], "k int, h array<long>")
    starts = F.slice("h", 1, F.greatest(F.size("h") - 4, F.lit(1)))
    want = F.transform(starts, lambda x, i: F.xxhash64(x, *[F.get("h", i + k) for k in range(1, 5)]))
    rows = df.select("k", line_dedup._shingles(5).alias("got"), want.alias("want")).collect()
    assert all(r["got"] == r["want"] and len(r["got"]) == max(r["k"] - 4, 1) for r in rows) and len(rows) == len(sizes)


def _sizes(names, types):
    """A stand-in for an operator's task: the rows and bytes of each Arrow batch that Spark sent."""

    def run(batches):
        for b in batches:
            values = {"doc_id": b.num_rows, "start": b.nbytes, "length": 1, "n_shingles": b.nbytes}
            yield pa.RecordBatch.from_arrays([pa.array([values.get(n)], t) for n, t in zip(names, types)], names=names)

    return run


def test_spark_sends_batches_by_size(spark, monkeypatch):
    """Before, a batch held 10,000 rows or 64 MB."""
    docs = spark.range(4000).coalesce(1).select(F.col("id").alias("doc_id"), F.repeat(F.col("id").cast("string"), 500).alias("text"))
    was, limit = spark.conf.get(common.BATCH_BYTES), 200_000
    names, types = ["doc_id", "piece", "start", "length", "ids_crc32"], [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()]
    monkeypatch.setattr(packing, "_cut", lambda *a: _sizes(names, types))
    monkeypatch.setattr(packing, "GROUP_BYTES", limit)
    found = packing.pack_documents(docs, "", 2).select("doc_id", "start").collect()
    assert sum(r["doc_id"] for r in found) == 4000 and len(found) > 20 and max(r["start"] for r in found) < 2 * limit
    names, types = ["doc_id", "n_shingles", "set_key", "bands"], [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())]
    monkeypatch.setattr(near_dup, "_sketches", lambda *a: _sizes(names, types))
    monkeypatch.setattr(near_dup, "TEXT_BYTES", limit)
    found = near_dup.near_duplicates(docs, 3, 85).select("n_shingles").collect()
    assert len(found) > 20 and max(r["n_shingles"] for r in found) < 2 * limit
    assert spark.conf.get(common.BATCH_BYTES) == was


def test_odd_words_are_remembered_for_a_while(monkeypatch):
    enc = encoders.WordEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [" ".join(f"{k}x{k * 7}" for k in range(n, n + 5000)) for n in range(0, 60_000, 5000)]
    assert [e for t in texts for e in enc.encode([t])] == [enc.whole(t) for t in texts]
    assert len(enc.other) + len(enc.other.old) <= 2 * encoders.MEMO_OTHERS


def test_each_shingle_is_in_the_query_once(spark):
    """Before, the shingles written out stood there twice."""
    assert str(line_dedup._shingles(5)).lower().count("xxhash64(") == line_dedup.UNROLLED + 1


def test_groups_of_tokens_have_one_key(spark):
    """Spark sorts by one whole number without comparing rows; before, there were two keys.  Numbers stay exact."""
    sets = spark.createDataFrame([(k, [-1, k, k // 2 + 10_000]) for k in range(3000)], "id long, tokens array<long>")
    held = line_dedup._holders(sets, "id", "tokens")
    plan = held._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(group" in plan and "spread" not in plan
    rows = held.collect()
    assert len(rows) == 9000
    for r in rows:
        assert r["holders"] == (line_dedup.HOT if r["token"] == -1 else 1 if r["token"] < 10_000 else 2)
