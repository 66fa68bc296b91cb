"""Mixing sources to target weights by hash-random order and exact cuts.

Every document gets a random key from a hash of its id.  Within its source, documents are
ranged by that key; prefix sums of sizes over the ranges, and then inside the one range in
which a source's budget ends, find the exact key at which to cut.  A source with a budget
of several times its size is taken whole that many times first.  What is a sum over all
rows is a plain aggregation by (source, range); only the ranges that hold a cut, one for
each source, are ordered row by row.

Edge cases: null text has size 0; null source is a source of its own, last in order; null
ids share one key; rows with equal keys at the cut share what is left of the budget in
proportion to their sizes; an empty table gives an empty result; other columns are kept
by :func:`mix` and ignored by :func:`plan_mix`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelkit.llm.common import count_words, materialize

#: Hash-random ranges of each source; they hold about equal shares of its rows.
RANGE_DIGITS = 3
BROADCAST_SOURCES = 10_000


def mixing_key(doc_id: Column) -> Column:
    """32 hexadecimal digits that look random and depend on the id alone."""
    return F.md5(F.concat(F.lit("mix:"), F.coalesce(doc_id.cast("string"), F.lit("null"))))


def source_targets(sizes: DataFrame, weights: list[int], share: float, most: int) -> DataFrame:
    """(source, source_size, target) for ``sizes`` with columns source and source_size.

    Weights repeat over the sources in code point order, null last.  Targets are in
    proportion to the weights, add up to ``share`` of all sizes, and none is above ``most``
    times its source's size: with sources ordered by size over weight, those before a
    point are at their limit and the rest share what is left.  One row for each source
    takes part here, no documents.
    """
    # Window() without keys: the input has one row for each source
    ordered = sizes.withColumn("nth", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1)
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("nth") % len(weights) + 1).cast("int"))
    rows = ordered.withColumn("weight", w.cast("double")).withColumn("limit", F.col("source_size").cast("double") * most)
    everything = Window.partitionBy()
    fill = Window.orderBy(F.col("limit") / F.col("weight"), "nth")
    before = F.coalesce(F.sum("limit").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    after = F.sum("weight").over(fill.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    total = F.sum("source_size").over(everything) * F.lit(share)
    rows = rows.withColumn("level", (total - before) / after)
    open_level = F.min(F.when(F.col("level") * F.col("weight") <= F.col("limit"), F.struct(F.col("limit") / F.col("weight"), F.col("nth"), F.col("level")))).over(everything)
    rows = rows.withColumn("open", open_level["level"])
    target = F.least(F.col("limit"), F.coalesce(F.col("open") * F.col("weight"), F.col("limit")))
    return rows.select("source", "source_size", target.alias("target"))


def _range(key: Column) -> Column:
    return F.substring(key, 1, RANGE_DIGITS)


def plan_mix(sized: DataFrame, weights: list[int], share: float = 1.5, most: int = 2) -> DataFrame:
    """One row for each source: targets, whole epochs, and where the last epoch is cut.

    ``sized`` has columns source, size and key and is read three times.
    """
    ranges = sized.groupBy("source", _range(F.col("key")).alias("range")).agg(F.sum("size").alias("range_size"))
    ranges = materialize(ranges, "mix-ranges")
    targets = source_targets(ranges.groupBy("source").agg(F.sum("range_size").alias("source_size")), weights, share, most)
    budget = F.floor(F.col("target")).cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    targets = targets.withColumn("epochs", epochs).withColumn("rest", budget - F.col("epochs") * F.col("source_size"))
    targets = materialize(targets, "mix-targets")
    order = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranges.withColumn("before", F.coalesce(F.sum("range_size").over(order), F.lit(0)))
    open_ranges = sums.join(targets, sums["source"].eqNullSafe(targets["source"])).where("before <= rest and rest < before + range_size").select(sums["source"].alias("cut_source"), F.col("range").alias("cut_range"), "before", "rest")
    # rows of the ranges that hold a cut: one of 16 ** RANGE_DIGITS of each source
    some = sized.withColumn("range", _range(F.col("key")))
    inside = some.join(_small(open_ranges), some["source"].eqNullSafe(F.col("cut_source")) & (F.col("range") == F.col("cut_range")))
    ties = inside.groupBy("source", "key").agg(F.sum("size").alias("tied"), F.first("before").alias("before"), F.first("rest").alias("rest"))
    order = Window.partitionBy("source").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    ties = ties.withColumn("before", F.col("before") + F.coalesce(F.sum("tied").over(order), F.lit(0)))
    cuts = ties.where("before <= rest and rest < before + tied").select(F.col("source").alias("cut_source"), F.col("key").alias("cut_key"), F.col("tied"), (F.col("rest") - F.col("before")).alias("cut_rest"))
    return targets.join(cuts, targets["source"].eqNullSafe(F.col("cut_source")), "left").drop("cut_source")


def _small(sources: DataFrame) -> DataFrame:
    """Broadcast a table of one row for each source if a count shows that it is small."""
    sources = materialize(sources, "mix-sources")
    return F.broadcast(sources) if sources.count() <= BROADCAST_SOURCES else sources


def taken(plan: DataFrame, sized: DataFrame) -> DataFrame:
    """``sized`` with source_size, target and the words ``taken`` of each row."""
    plan = plan.withColumnRenamed("source", "plan_source")
    joined = sized.join(_small(plan), F.col("source").eqNullSafe(F.col("plan_source"))).drop("plan_source")
    part = F.when(F.col("cut_key").isNull() | (F.col("key") > F.col("cut_key")), F.lit(0)).when(F.col("key") < F.col("cut_key"), F.col("size"))
    shared = F.when(F.col("size") == F.col("tied"), F.col("cut_rest")).otherwise(F.floor(F.col("size").cast("double") * F.col("cut_rest") / F.col("tied")))
    last = part.otherwise(shared).cast("long")
    return joined.withColumn("taken", F.col("size") * F.col("epochs") + last)


def mix_sizes(docs: DataFrame, weights: list[int], share: float = 1.5, most: int = 2) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row of ``docs``."""
    sized = docs.select("doc_id", "source", count_words(F.col("text")).alias("size"), mixing_key(F.col("doc_id")).alias("key"))
    sized = materialize(sized, "mix-sized")
    plan = plan_mix(sized, weights, share, most)
    return taken(plan, sized).select("doc_id", "size", "source_size", "target", "taken")


def mix(docs: DataFrame, weights: list[int], share: float = 1.5, most: int = 2) -> DataFrame:
    """Rows of ``docs``, each as many times as the mix takes it.

    A document that a cut takes in part appears once more with the words it is taken for.
    """
    names = docs.columns
    row = docs.select(F.struct(*[F.col(c) for c in names]).alias("row"), "source", count_words(F.col("text")).alias("size"), mixing_key(F.col("doc_id")).alias("key"))
    sized = materialize(row.select("source", "size", "key"), "mix-sized")
    out = taken(plan_mix(sized, weights, share, most), row)
    text = F.col("row.text")
    whole = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(1).cast("int")
    partly = F.when(F.col("size") > 0, F.col("taken") % F.col("size")).otherwise(0)
    pieces = F.array_repeat(text, whole)
    first_words = F.array_join(F.slice(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda x: x != ""), 1, F.greatest(partly, F.lit(1)).cast("int")), " ")
    pieces = F.concat(pieces, F.when(partly > 0, F.array(first_words)).otherwise(F.array().cast("array<string>")))
    exploded = out.select("row", F.explode(pieces).alias("piece"))
    columns = [F.col("piece").alias(c) if c == "text" else F.length("piece").cast("long").alias(c) if c == "n_chars" else F.col(f"row.{c}").alias(c) for c in names]
    return exploded.select(*columns)
