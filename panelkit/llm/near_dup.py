"""Near-duplicate groups by one-permutation MinHash.

A document's set is its distinct shingles.  One hash function puts each shingle in one of
``BINS`` bins; a bin keeps its least value.  Empty bins take the value of a bin that is
not empty, found by a probe sequence that depends on the bin and the attempt (optimal
densification).  Bands of ROWS bins make buckets; documents that share a bucket are
candidates.

Sets so small that linked ones differ by one shingle at most also get a bucket for the
whole set and one for the set without each shingle, so their candidates are exact.

Documents with equal sets are one class, and only classes take part.  Each bucket sends
*stars*: edges from a centre to the others, never all pairs.  The first centre is the
member that shares the most buckets.  Edges are checked on the full sets, and checked
links grow components.  Buckets whose members are not yet in one component go on with
further centres, eight times as many in each round; edges only go to members of other
components, and only where a link is not ruled out by what is known of both ends:

- The intersection with the first centre c is known from the first round.  x lacks m of
  c's shingles and y lacks m', so inside c they differ by ``|m - m'|`` shingles at least.
- u and u' of their shingles are in no other open set.  Outside c, they have w and w' that
  are neither in c nor theirs alone.  So x and y differ by
  ``u + u' + |m - m'| + |w - w'|`` shingles at least, and a link allows
  ``(n + n') (100 - percent) / (100 + percent)``.

Members with no possible partner left go, so in the end every two members of a bucket are
connected, were compared, or can't be linked.

Edge cases: a null text, or one without words, has the empty set, which is linked with
nothing; a text with fewer words than a shingle has one shingle, the whole sequence; null
ids take the component of their text's class if it has one and are kept; rows that repeat an id
are classes of that id; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelkit.llm.common import by_size, discard, materialize

BIN_BITS = 8
BINS = 1 << BIN_BITS
ROWS = 6
BANDS = BINS // ROWS
GROWTH = 8
MEMO_WORDS = 500_000
#: Bytes of text that go to Python at a time.
TEXT_BYTES = 1 << 22
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _probes() -> np.ndarray:
    """For each bin, the bins that densification tries, in order."""
    bins, tries = np.arange(BINS, dtype=np.uint64)[:, None], np.arange(1, 8 * BINS + 1, dtype=np.uint64)
    return (_mix(bins * _ODD[0] + tries * _ODD[1]) >> np.uint64(64 - BIN_BITS)).astype(np.int32)


class Shingler:
    """Sorted distinct 64-bit hashes of a text's word shingles."""

    class _Memo(dict):
        def __missing__(self, word):
            if len(self) >= MEMO_WORDS:
                self.clear()
            self[word] = h = xxhash.xxh3_64_intdigest(word)
            return h

    def __init__(self, width: int):
        self.width, self.memo = width, self._Memo()
        self.factors = [_mix(np.array([k + 1], np.uint64))[0] | np.uint64(1) for k in range(width)]

    def __call__(self, text: str | None) -> np.ndarray:
        # bytes.lower and bytes.split know exactly A-Z and the six white space characters
        found = (text or "").encode().lower().split()
        if not found:
            return np.zeros(0, np.uint64)
        w = np.fromiter(map(self.memo.__getitem__, found), np.uint64, len(found))
        n = max(1, len(w) - self.width + 1)
        h = np.full(n, len(w) if len(w) < self.width else self.width, np.uint64)
        for k in range(min(self.width, len(w))):
            h = _mix(h + w[k : k + n] * self.factors[k])
        return np.unique(h)


def sketch(hashes: np.ndarray, probes: np.ndarray) -> np.ndarray:
    """The densified one-permutation sketch of a set that isn't empty; ``hashes`` is sorted."""
    bins = (hashes >> np.uint64(64 - BIN_BITS)).astype(np.int32)
    first = np.append(0, np.flatnonzero(np.diff(bins)) + 1)
    out, full = np.zeros(BINS, np.uint64), np.zeros(BINS, bool)
    out[bins[first]], full[bins[first]] = hashes[first], True
    empty = np.flatnonzero(~full)
    if len(empty):
        hit = full[probes[empty]]
        at = hit.argmax(axis=1)
        source = probes[empty, at]
        # a probe sequence that never meets a full bin falls back to the first full one
        source = np.where(hit[np.arange(len(empty)), at], source, bins[first[0]])
        out[empty] = out[source]
    return out


def _small(percent: int) -> int:
    """The size up to which two linked sets differ by one element at most."""
    return ((2 * (100 + percent) - 1) // (100 - percent) + 1) // 2 if percent < 100 else 0


def _neighbours(hashes: np.ndarray) -> np.ndarray:
    """Buckets of a set and of the set without each element; hashes of sets are the XOR of their elements."""
    whole = np.bitwise_xor.reduce(hashes)
    return _mix(np.append(whole, whole ^ hashes) * _ODD[3] + _ODD[4])


def _sketches(width: int, percent: int):
    def run(batches):
        shingle, probes, small = Shingler(width), _probes(), _small(percent)
        for batch in by_size(batches, "text"):
            ids, sizes, keys, bands = [], [], [], []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                h = shingle(text)
                ids.append(doc_id)
                sizes.append(len(h))
                if not len(h):
                    keys.append(None)
                    bands.append(None)
                    continue
                keys.append(xxhash.xxh3_128_digest(h.tobytes()))
                s = sketch(h, probes)[: BANDS * ROWS].reshape(BANDS, ROWS)
                code = np.arange(BANDS, dtype=np.uint64)
                for k in range(ROWS):
                    code = _mix(code * _ODD[2] + s[:, k])
                if len(h) <= small:
                    code = np.append(code, _neighbours(h))
                bands.append(code.view(np.int64).tolist())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "set_key", "bands"])

    return run


def _sets(width: int):
    def run(batches):
        shingle = Shingler(width)
        for batch in by_size(batches, "text"):
            sets = [shingle(t).tobytes() for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["node"], pa.array(sets, pa.binary())], names=["node", "hashes"])

    return run


def _verify(percent: int):
    def run(batches):
        for batch in batches:
            out = [[], [], [], []]
            for a, b in zip(batch["hashes_a"], batch["hashes_b"]):
                x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                both = int((y[at] == x).sum())
                for column, value in zip(out, (len(x), len(y), both, 100 * both >= percent * (len(x) + len(y) - both))):
                    column.append(value)
            columns = [pa.array(c, t) for c, t in zip(out, (pa.int32(), pa.int32(), pa.int32(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"], *columns], names=["a", "b", "size_a", "size_b", "common", "linked"])

    return run


def components(links: DataFrame) -> DataFrame:
    """(node, component): the least node reachable over ``links`` (a, b), for every linked node.

    Labels take the least label of their neighbours and then that label's own label, until
    nothing changes; each round is a stored table.
    """
    both = materialize(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = materialize(both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("component")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), F.col("component").alias("near")), "b").groupBy("a").agg(F.min("near").alias("near"))
        step = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("up"))
        new = materialize(step.join(jump, "component", "left").select("node", "old", F.least("component", F.coalesce("up", "component")).alias("component")), "labels")
        changed = new.where("old <> component").limit(1).count()
        discard(labels)
        labels = new.select("node", "component")
        if not changed:
            discard(both)
            return labels


def near_duplicates(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row.

    Rows are linked if ``100 * |intersection| >= percent * |union|`` of their shingle sets.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketches = materialize(rows.mapInArrow(_sketches(width, percent), "doc_id long, n_shingles long, set_key binary, bands array<bigint>"), "sketches", "lz4", TEXT_BYTES)
    classes = sketches.where("set_key is not null and doc_id is not null").groupBy("set_key").agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands"))
    # a document whose id is not unique may stand for several classes; the id then joins them
    every = materialize(classes.select("node", F.explode("bands").alias("bucket")), "members")
    shared = every.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = every.join(shared, "bucket").select("bucket", "node", "size").distinct()
    central = members.groupBy("node").agg(F.sum("size").alias("central"))
    members = materialize(members.select("bucket", "node").join(central, "node"), "members")
    discard(every)
    wanted = members.select("node").distinct()
    first_text = rows.join(wanted.withColumnRenamed("node", "doc_id"), "doc_id", "left_semi").select(F.col("doc_id").alias("node"), "text")
    sets = materialize(first_text.mapInArrow(_sets(width), "node long, hashes binary"), "sets", "none", TEXT_BYTES)
    order = F.struct((-F.col("central")).alias("central"), F.col("node").alias("node"))
    centres = members.groupBy("bucket").agg(F.min(order)["node"].alias("centre"))
    # from here on a bucket is named by its centre, so buckets of one centre are one and a pair meets there once
    starred = members.select("bucket", "node").join(centres, "bucket").select(F.col("centre").alias("bucket"), "centre", "node").distinct()
    starred = materialize(starred, "starred")
    discard(members)
    checked = _checked(starred.select(F.col("centre").alias("a"), F.col("node").alias("b")).where("a <> b"), sets, percent)
    links = checked.where("linked").select("a", "b")
    labels = components(links)
    live = _live(starred, checked, labels, sets, percent)
    most = GROWTH
    while not live.isEmpty():
        now = live.where(F.col("turn") < most)
        mine = now.select("bucket", *[F.col(c).alias(c + "_a") for c in ("node", "component", "bound", "lacks", "others")])
        edges = live.join(mine, "bucket").where((F.col("component") != F.col("component_a")) & _possible(percent, "_a") & (F.abs(F.col("others") - F.col("others_a")) * (100 + percent) + _distance(percent, "_a") <= 0))
        more = _checked(edges.select(F.col("node_a").alias("a"), F.col("node").alias("b")), sets, percent)
        links = links.unionByName(more.where("linked").select("a", "b"))
        if not more.where("linked").isEmpty():
            discard(labels)
            labels = components(links)
        rest = live.where(F.col("turn") >= most).drop("component")
        most *= GROWTH
        after = materialize(_with_partner(_labelled(rest, labels), percent), "live")
        discard(live)
        live = after
    leader = classes.select("set_key", "node")
    placed = sketches.drop("bands").join(leader, "set_key", "left").join(labels, "node", "left")
    component = F.coalesce("component", "node", "doc_id")
    return placed.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Rows of ``docs``, all columns, with one document of each near-duplicate group.

    Each row is judged by its own text.  Rows that repeat id and text are one document, and
    unlike texts of a repeated id are documents of their own, of which one keeps the id among
    equals; rows with a null id all stay.  Ids of repeated rows need room for fresh numbers, so
    they may lie beyond 2^62 on one side of zero only.
    """
    keyed = docs.select("*", F.col("doc_id").cast("long").alias("__key"))
    ids = docs.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("__key")).agg(F.count(F.lit(1)).alias("__n"))
    repeated = materialize(ids.where("__n > 1").select("__key"), "repeated-ids")
    if not repeated.isEmpty():
        lo, hi = keyed.agg(F.min("__key"), F.max("__key")).first()
        if hi >= 1 << 62 and lo <= -(1 << 62):
            raise ValueError("ids lie beyond 2^62 on both sides of zero")
        again = keyed.join(repeated, "__key", "left_semi").dropDuplicates(["doc_id", "text"])
        # the least text of an id keeps it, so its group's least id is what it would be without the others
        first = again.groupBy("__key").agg(F.min("text").alias("__least"))
        again = again.join(first, "__key").withColumn("__fresh", F.monotonically_increasing_id())
        fresh = F.lit(hi + 1) + F.col("__fresh") if hi < 1 << 62 else F.lit(lo - 1) - F.col("__fresh")
        again = again.withColumn("__key", F.when(F.col("text").eqNullSafe(F.col("__least")), F.col("__key")).otherwise(fresh)).drop("__least", "__fresh")
        # stored, as fresh numbers hold for one run only
        again = materialize(again.select(keyed.columns), "repeated-rows")
        keyed = keyed.join(repeated, "__key", "left_anti").select(keyed.columns).unionByName(again)
    gone = near_duplicates(keyed.select(F.col("__key").alias("doc_id"), "text"), width, percent).where(~F.col("kept")).select(F.col("doc_id").alias("__key")).distinct()
    return keyed.join(gone, "__key", "left_anti").select(docs.columns)


def _checked(edges: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, size_a, size_b, common, linked) of each distinct edge, a < b, from the full sets."""
    edges = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = edges.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("hashes_a")), "a").join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("hashes_b")), "b")
    return materialize(pairs.mapInArrow(_verify(percent), "a long, b long, size_a int, size_b int, common int, linked boolean"), "checked")


def _labelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    """``members`` with the component of their node."""
    return members.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))


def _tokens(batches):
    for batch in batches:
        sets = [np.frombuffer(h, np.int64) for h in batch["hashes"].to_pylist()]
        nodes = np.repeat(batch["node"].to_numpy(), [len(h) for h in sets])
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(np.concatenate([*sets, np.zeros(0, np.int64)]))], names=["node", "token"])


def _distance(percent: int, suffix: str) -> Column:
    """At most 0 unless the sizes, own shingles and missing shingles of two members rule a link out."""
    return F.col("bound") + F.col("bound" + suffix) + (100 + percent) * F.abs(F.col("lacks") - F.col("lacks" + suffix))


def _possible(percent: int, suffix: str) -> Column:
    return _distance(percent, suffix) <= 0


def _live(starred: DataFrame, checked: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Members that can still have a link, with what bounds their links.

    bucket, node, component; bound: (100 + percent) u - (100 - percent) n; lacks: m;
    others: w; turn: the expected number of members of the bucket whose turn as a centre
    comes before.
    """
    found = _labelled(starred, labels)
    state = found.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("size"))
    found = materialize(found.join(state.where("lo < hi").select("bucket", "size"), "bucket"), "unsettled")
    # centres belong to it, so that no shingle of a centre counts as another's own
    open_sets = sets.join(found.select("node").distinct(), "node")
    tokens = materialize(open_sets.mapInArrow(_tokens, "node long, token long"), "tokens")
    shared = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("token")
    hits = tokens.join(shared, "token").groupBy("node").agg(F.count(F.lit(1)).alias("shared"))
    size = (F.length("hashes") / 8).cast("long")
    good = materialize(open_sets.select("node", size.alias("n")).join(hits, "node").where(F.col("shared") * 100 >= F.col("n") * percent), "hopeful")
    discard(tokens)
    pair = checked.select(F.col("a").alias("lo"), F.col("b").alias("hi"), "size_a", "size_b", "common")
    found = found.where("node <> centre").join(good, "node")
    found = found.withColumn("lo", F.least("node", "centre")).withColumn("hi", F.greatest("node", "centre")).join(pair, ["lo", "hi"])
    centre_size = F.when(F.col("centre") == F.col("lo"), F.col("size_a")).otherwise(F.col("size_b"))
    own = F.col("n") - F.col("shared")
    live = found.select(
        "bucket", "node", "component",
        ((100 + percent) * own - (100 - percent) * F.col("n")).alias("bound"),
        (centre_size - F.col("common")).cast("long").alias("lacks"),
        (F.col("shared") - F.col("common")).cast("long").alias("others"),
        (F.pmod(F.xxhash64("node"), F.lit(1 << 30)) * F.col("size") / (1 << 30)).alias("turn"),
    )
    live = materialize(live, "live")
    out = materialize(_with_partner(live, percent), "live")
    discard(live)
    return out


def _with_partner(live: DataFrame, percent: int) -> DataFrame:
    """``live`` members that have a possible partner in another component of their bucket."""
    cells = live.groupBy("bucket", "component", "lacks").agg(F.min("bound").alias("bound"))
    cells = cells.select("bucket", *[F.col(c).alias(c + "_c") for c in ("component", "bound", "lacks")])
    hit = (live["bucket"] == cells["bucket"]) & (F.col("component") != F.col("component_c")) & _possible(percent, "_c")
    return live.join(cells, hit, "left_semi")
