"""Line deduplication by an exact set-similarity join.

A line's tokens are its distinct shingles of ``width`` lower-cased words (a shorter line is
one token, a line without a word has none and is never removed).  Lines with equal token
sets are one class.  Classes are joined by prefix filtering: with tokens ordered by rarity,
two sets of Jaccard ``least`` or more share one of their first ``n - ceil(least n) + 1``
tokens.  Length and position filters apply in the join, and pairs are verified on the full
sets.  A line goes if a line before it, in order of (doc_id, line), is in its class or in
one linked with it.

Rarity is a token's count over the classes that can have a link at all, taken where the
tokens are hash-partitioned; ties go by the token's hash.  Which classes those are comes from two exact
bounds, so no counts of the many tokens that only one line has are needed:

1. Two linked sets share ``k`` of their first ``n - ceil(least n) + k`` tokens in *any* one
   order.  Each class publishes such a prefix in hash order, with k growing with n, and
   stays if enough of it is published by another class.  Only counts by token and by class
   are made here, no pairs.
2. A link takes ``least`` of a set into the intersection, so a class stays if that many of
   its tokens are in other classes that stayed after the first bound.

A pair of classes meets at the first prefix token they share, and only there, so it comes
out of the join once.  The join also tests the parity bits of the sets: each token flips
one of 256 bits, so two sets differ in at least as many tokens as their bits differ in.
Full sets move only for the pairs that pass.

Edge cases: null text has no lines and stays null; blank lines stay; null ids come last;
rows that repeat both id and text get the same result and don't match one another; a
document that loses all its lines has the empty text; other columns are kept, but input
columns named n_lines, removed_lines or n_links are replaced by the output's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelkit.llm.common import SPACE, discard, fresh, materialize

WIDTH = 5
LEAST = 0.8
#: Share of a class's tokens by which its published prefix is longer than one shared token asks for.
EXTRA = 0.05
#: Tokens that make up one in HEAVY of the rows of one in SAMPLE sets, and HEAVY_LEAST rows, are spread over SPREAD groups.
SAMPLE, HEAVY, HEAVY_LEAST, SPREAD, HOT = 64, 1 << 16, 8, 1024, 1 << 40
#: Shingles of a line that are written out in the query, and how many of them are made at a time.
UNROLLED, BLOCK = 96, 32
#: Words of 64 parity bits.
PARITY = 4
#: Small tables are broadcast if their numbers, array elements included, are no more than this.
BROADCAST_NUMBERS = 1_000_000


def _key(line: str = "line") -> Column:
    """Order of lines: by id, null last, then text, then line."""
    return F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash", F.col(line).alias("line"))


def _plain_lines(low: str) -> Column:
    """The lines of a text in lower case, with plain spaces for the other white space.

    Both are done for a text at once, which is cheaper than for each line.  ``low`` is a column
    of its own, or the text would be put in lower case for each use of it.
    """
    odd = F.col(low).contains("\t") | F.col(low).contains("\x0b") | F.col(low).contains("\x0c") | F.col(low).contains("\r")
    return F.split(F.when(odd, F.regexp_replace(low, r"[\x09\x0B-\x0D]", " ")).otherwise(F.col(low)), "\n")


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, line, t): every line of every text, as ``_plain_lines`` gives it."""
    low = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.lower("text").alias("low"))
    return low.select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(_plain_lines("low")).alias("line", "t"))


def _shingles(width: int) -> Column:
    """Hashes of ``width`` word hashes in a row, of array ``h``; of all of them if they are fewer.

    The first UNROLLED are written out, as Spark generates code for them, in blocks that are
    made only where a line has so many; a lambda function, which the rest have, is interpreted
    for each shingle.  Each block is in the query once, as code that is too long stays slow.
    """
    count, n = F.greatest(F.size("h") - (width - 1), F.lit(1)), UNROLLED

    def block(at: int) -> Column:
        made = F.array(*[F.xxhash64(*[F.get("h", F.lit(i + k)) for k in range(width)]) for i in range(at, at + BLOCK)])
        made = F.slice(made, 1, F.least(count - at, F.lit(BLOCK)))
        return made if at == 0 else F.when(count > at, made).otherwise(F.array().cast("array<bigint>"))

    rest = F.transform(F.slice("h", n + 1, F.greatest(count - n, F.lit(0))), lambda x, i: F.xxhash64(x, *[F.get("h", i + (n + k)) for k in range(1, width)]))
    return F.concat(*[block(at) for at in range(0, n, BLOCK)], rest)


def _with_tokens(lines: DataFrame, width: int, *keep: str) -> DataFrame:
    """Columns ``keep`` with n and tokens: sorted distinct token hashes of each line with a word."""
    # a test of the line itself, as one of its words would split it a second time
    d = lines.where(F.trim("t") != "").withColumn("w", F.array_remove(F.split("t", " "), "")).drop("t")
    d = d.withColumn("h", F.transform("w", lambda x: F.xxhash64(x))).drop("w")
    d = d.withColumn("tokens", F.sort_array(F.array_distinct(_shingles(width)))).drop("h")
    return d.select(*keep, F.size("tokens").alias("n"), "tokens")


def line_sets(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, text_hash, line, n, tokens) of each line with a word."""
    return _with_tokens(_lines(docs), width, "doc_id", "text_hash", "line")


def _parity() -> Column:
    """The parity bits of ``tokens``, as PARITY numbers of 64 bits."""
    return F.expr(f"transform(sequence(0, {PARITY - 1}), q -> aggregate(tokens, 0L, (s, x) -> s ^ if((shiftright(x, 6) & {PARITY - 1}) = q, shiftleft(1L, int(x & 63)), 0L)))")


def _second(df: DataFrame) -> DataFrame:
    """``df`` with the names of the second class of a pair."""
    return df.select(*[F.col(c).alias(c + "2") for c in df.columns])


def _prefix_length(least: float) -> Column:
    return (F.col("n") - F.ceil(F.col("n") * F.lit(least)) + 1).cast("int")


def _names() -> list[Column]:
    """The two hashes that name a class: of all its tokens, and of their number and three of them."""
    some = [F.get("tokens", at.cast("int")) for at in (F.lit(0), F.size("tokens") / 2, F.size("tokens") - 1)]
    return [F.xxhash64("tokens").alias("a"), F.xxhash64(F.size("tokens"), *some).alias("b")]


def _sets(docs: DataFrame, classes: DataFrame, width: int) -> DataFrame:
    """(a, b, n, tokens, first) of the given classes, built again from the text of their first lines.

    A document gets the places of its wanted lines, so no other line leaves its scan.
    """
    at = classes.select(F.col("first.doc_id").alias("k_id"), F.col("first.text_hash").alias("k_hash"), F.col("first.line").alias("place"))
    keys = materialize(at.groupBy("k_id", "k_hash").agg(F.collect_set("place").alias("places")), "wanted-lines")
    keys = _broadcast_if_small(keys, F.size("places") + 4)
    hit = F.col("doc_id").cast("long").eqNullSafe(F.col("k_id")) & (F.xxhash64("text") == F.col("k_hash"))
    found = docs.select("doc_id", "text").join(keys, hit).select("k_id", "k_hash", F.lower("text").alias("low"), "places")
    found = found.select("k_id", "k_hash", _plain_lines("low").alias("all"), "places")
    lines = found.select(F.col("k_id").alias("doc_id"), F.col("k_hash").alias("text_hash"), F.explode(F.transform("places", lambda k: F.struct(k.alias("line"), F.get("all", k).alias("t")))).alias("x"))
    lines = lines.select(_key("x.line").alias("first"), "x.t")
    return _with_tokens(lines, width, "first").select(*_names(), "n", "tokens", "first").dropDuplicates(["a", "b"])


def _broadcast_if_small(df: DataFrame, numbers: Column) -> DataFrame:
    """``df``, to be broadcast if its rows hold BROADCAST_NUMBERS ``numbers`` at most."""
    total = df.agg(F.coalesce(F.sum(numbers), F.lit(0))).first()[0]
    return F.broadcast(df) if total <= BROADCAST_NUMBERS else df


def _holders(sets: DataFrame, key: str, tokens: str) -> DataFrame:
    """(key, token, holders): each token of each set with the number of sets that hold it.

    ``key`` names a set.  Tokens that many sets hold are found in a sample of the sets.
    Their rows are spread over many groups and get HOT as the number, so no group of equal
    tokens grows with the table.  What the sample misses costs balance, not results.
    """
    some = sets.where(F.pmod(F.xxhash64(key), F.lit(SAMPLE)) == 0).select(F.explode(tokens).alias("token"))
    some = some.groupBy("token").agg(F.count(F.lit(1)).alias("rows"))
    total = some.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    # each has a HEAVY-th of the sampled rows or more, so there are HEAVY of them at most
    heavy = F.broadcast(some.where(F.col("rows") >= max(HEAVY_LEAST, -(-total // HEAVY))).select("token", F.lit(1).alias("heavy")))
    rows = sets.select(key, F.explode(tokens).alias("token")).join(heavy, "token", "left")
    part = F.xxhash64("token", F.pmod(F.xxhash64(key), F.lit(SPREAD)))
    # never the token itself; should it be another one, that one's number is too high, which costs no results
    part = F.when(part == F.col("token"), F.bitwise_not(part)).otherwise(part)
    # one column names a group, as Spark sorts by one whole number without comparing rows
    rows = rows.select(key, "token", F.when(F.col("heavy") == 1, part).otherwise(F.col("token")).alias("group"))
    number = F.count(F.lit(1)).over(Window.partitionBy("group"))
    return rows.select(key, "token", F.when(F.col("token") != F.col("group"), F.lit(HOT)).otherwise(number).alias("holders"))


def _may_have_links(classes: DataFrame, least: float) -> DataFrame:
    """The ``classes`` of which other classes publish enough tokens (the first bound)."""
    hits = _holders(classes, "a", "published").where("holders > 1").groupBy("a").agg(F.count(F.lit(1)).alias("hits"))
    enough = F.col("hits") >= 1 + F.floor(F.col("n") * F.lit(least * EXTRA) - 1e-9)
    return classes.drop("published").join(hits, "a").where(enough).drop("hits")


def _open_sets(sets: DataFrame, least: float) -> DataFrame:
    """``sets`` within the second bound, with the part of their rarity prefix that others can share.

    ``prefix`` has the tokens that other classes hold too, the rarest first; before them
    come ``own`` tokens that no other class holds, which can't match.
    """
    shared = _holders(sets, "id", "tokens").where("holders > 1")
    # at most as many as the line has tokens
    ordered = shared.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("holders", "token"))).alias("ordered"))
    found = sets.join(ordered, "id").withColumn("own", F.col("n") - F.size("ordered"))
    found = found.where(F.size("ordered") >= F.col("n") * F.lit(least) - 1e-9)
    return found.withColumn("prefix", F.slice(F.col("ordered.token"), 1, _prefix_length(least) - F.col("own"))).withColumn("bits", _parity()).drop("ordered")


def linked_classes(docs: DataFrame, width: int = WIDTH, least: float = LEAST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lines, classes, links).

    lines: (doc_id, text_hash, line, a, b); classes: (a, b, n, first, copies), with a, b the
    two hashes that name a class and first its first line; links: (a, b, first2), both ways,
    with the first line of the other class.
    """
    more = F.floor(F.col("n") * F.lit(EXTRA) + 1e-9).cast("int")
    published = F.slice(F.col("tokens"), 1, _prefix_length(least) + more)
    wide = line_sets(docs, width).select("doc_id", "text_hash", "line", *_names(), "n", published.alias("published"))
    wide = materialize(wide, "lines-with-prefixes", "lz4")
    classes = wide.groupBy("a", "b").agg(F.min(_key()).alias("first"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("published").alias("published"))
    classes = materialize(classes, "line-classes", "lz4")
    # from here on each class has its prefix, so lines go on without
    lines = materialize(wide.select("doc_id", "text_hash", "line", "a", "b"), "lines")
    discard(wide)
    sets = _sets(docs, _may_have_links(classes, least), width).withColumn("id", F.monotonically_increasing_id())
    sets = materialize(sets, "line-sets", "none")
    opened = materialize(_open_sets(sets, least), "open-sets", "none")
    discard(sets)
    rows = opened.select("id", "n", "own", "bits", "prefix", F.posexplode("prefix").alias("place", "token"))
    left = rows.select("token", "id", "n", (F.col("own") + F.col("place")).alias("place"), "bits", F.slice("prefix", 1, F.col("place")).alias("earlier"))
    # both sides by the same plan, so that its exchange is made once
    x, y = (lambda c: F.col("x." + c)), (lambda c: F.col("y." + c))
    lengths = F.least(x("n"), y("n")) >= F.greatest(x("n"), y("n")) * F.lit(least)
    most_common = F.least(x("n") - x("place"), y("n") - y("place"))
    needed = (x("n") + y("n")) * F.lit(least / (1 + least)) - 1e-9
    differ = F.expr(" + ".join(f"bit_count(x.bits[{q}] ^ y.bits[{q}])" for q in range(PARITY)))
    first_met = ~F.arrays_overlap(x("earlier"), y("earlier"))
    hit = (x("token") == y("token")) & (x("id") < y("id")) & lengths & (most_common >= F.ceil(needed)) & ((x("n") + y("n") - differ) / 2 >= needed) & first_met
    near = left.alias("x").join(left.alias("y"), hit).select(x("id").alias("id"), y("id").alias("id2"))
    sets = opened.select("id", "a", "b", "first", "n", "tokens")
    both = near.join(sets, "id").join(_second(sets), "id2")
    shared = F.size(F.array_intersect("tokens", "tokens2"))
    enough = shared >= (F.col("n") + F.col("n2") - shared) * F.lit(least)
    one_way = materialize(both.where(enough).select("a", "b", "first", "a2", "b2", "first2"), "line-links")
    discard(opened)
    links = one_way.select("a", "b", "first2").unionByName(one_way.select(F.col("a2").alias("a"), F.col("b2").alias("b"), F.col("first").alias("first2")))
    return lines, classes.select("a", "b", "n", "first", "copies"), links


def dedup_lines(docs: DataFrame, width: int = WIDTH, least: float = LEAST, counts: bool = True) -> DataFrame:
    """``docs`` with later matches of lines taken out of ``text``, and n_lines, removed_lines, n_links.

    n_lines counts lines with a word, removed_lines holds the places (from 0) of those taken
    out, n_links the links of the document's lines to other classes of lines.  Without
    ``counts`` only the columns of ``docs`` come back, all but the text as they were.
    """
    lines, classes, links = linked_classes(docs, width, least)
    # classes of one line without links change nothing; one of one line needs no first of its own
    repeated = classes.where("copies > 1").select("a", "b", F.col("first").alias("reach"), F.lit(0).cast("long").alias("links"))
    linked = links.select("a", "b", F.col("first2").alias("reach"), F.lit(1).cast("long").alias("links"))
    reach = repeated.unionByName(linked).groupBy("a", "b").agg(F.min("reach").alias("reach"), F.sum("links").alias("links"))
    told = lines.join(reach, ["a", "b"]).withColumn("gone", _key() > F.col("reach")).where("gone or links > 0")
    per_row = told.groupBy("doc_id", "text_hash", "line").agg(F.first("gone").alias("gone"), F.first("links").alias("links"))
    own_id, own_hash, gone, n_links = (fresh(docs, name) for name in ("id", "hash", "removed", "links"))
    by_doc = per_row.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_list(F.when(F.col("gone"), F.col("line")))).alias(gone), F.sum("links").alias(n_links))
    # the texts are exchanged at every size; they stream past the lists of places and aren't sorted
    by_doc = by_doc.withColumnRenamed("doc_id", own_id).withColumnRenamed("text_hash", own_hash).hint("shuffle_hash")
    hit = F.col("doc_id").cast("long").eqNullSafe(F.col(own_id)) & (F.xxhash64("text") == F.col(own_hash))
    joined = docs.join(by_doc, hit, "left")
    removed = F.coalesce(gone, F.array().cast("array<int>"))
    kept = F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(F.col(gone), i))
    text = F.when(F.size(removed) > 0, F.array_join(kept, "\n")).otherwise(F.col("text"))
    # a match starts at the first character of a line that isn't white space and takes the rest
    n_lines = F.regexp_count("text", F.lit(f"[^{SPACE}][^\n]*"))
    if not counts:
        return joined.select(*[text.alias(c) if c == "text" else F.col(c) for c in docs.columns])
    columns = [text.alias(c) if c == "text" else F.col(c) for c in docs.columns if c not in ("n_lines", "removed_lines", "n_links")]
    return joined.select(*columns, F.coalesce(n_lines, F.lit(0)).cast("long").alias("n_lines"), removed.alias("removed_lines"), F.coalesce(n_links, F.lit(0)).cast("long").alias("n_links"))
