"""Document fingerprints by spot signatures.

A signature starts at each common word of a text (an *anchor*) and chains the ``chain``
content words, those that aren't common, that come next.  With ``far`` a content word is an
anchor too if the ``far`` words before it, or all words before it, are content words, so
stretches in languages without listed common words are covered; a text that has no signature
then has its own hash as one.  The fingerprint is the set of distinct signatures, written as their sorted hashes.  Likeness is the Jaccard coefficient
of two sets; sets whose lengths alone rule out the wanted likeness aren't compared.

Only DataFrame functions are used.  Neighbours in ``doc_id`` order meet by order-preserving
buckets of equal row counts: a document's bucket is all it is shuffled by, and the first
document of each bucket is copied to the bucket before it.

Edge cases: a null text is empty; an empty text and, without ``far``, any text with no anchor
that content follows have the empty set, with the empty string as fingerprint; two empty sets have likeness 1, an empty and
another 0; ids may repeat (equal ids are ordered by text) or be null (last); a single
document is its own neighbour; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelkit.llm.common import IdRanges, materialize

CHAIN = 2
#: Words without a listed anchor after which content words are anchors, in the query.
FAR = 8
ROWS_PER_BUCKET = 512
#: Bounds the table of buckets that is broadcast, three numbers each; larger inputs get larger buckets.
MAX_BUCKETS = 1 << 18
#: Common words of English, German, French and Spanish.
ANCHORS = (
    "the of and to in a is that for it with as was on by be at from this an are or "
    "der die das und ist in den von zu mit sich des auf für nicht ein eine dem im auch als es an aus wie bei "
    "le la les de des et à un une du en que qui est dans pour au sur par pas plus avec ce se sont "
    "el los las y del una con por su para al lo como más pero sus o este ha sí porque esta entre se no"
)


def anchor_words() -> list[str]:
    return sorted(set(ANCHORS.split()))


def with_signatures(df: DataFrame, text: str, out: str, chain: int = CHAIN, far: int | None = None) -> DataFrame:
    """``df`` with column ``out``: sorted distinct signature hashes of column ``text``.

    Intermediate columns are used more than once, so that the optimiser keeps each a step
    of its own and no array is built again for every element.
    """
    w, at = "__words", "__content"
    cleaned = F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+", " ")
    df = df.withColumn(w, F.split(F.trim(cleaned), " "))
    is_content = lambda t: ~t.isin(anchor_words())
    df = df.withColumn(at, F.filter(F.transform(w, lambda t, i: F.when(is_content(t), i + 1)), lambda i: i.isNotNull()))
    # content word number k (from 0) follows anchors if it isn't right after another content word
    last = F.size(at) - chain

    def spots(position, k):
        previous = F.when(k == 0, 0).otherwise(F.get(F.col(at), k - 1))
        gap = position - previous - 1
        words = [F.get(F.col(w), F.get(F.col(at), k + j) - 1) for j in range(chain)]
        anchors = F.slice(F.col(w), previous + 1, gap)
        return F.when((gap > 0) & (k <= last), F.transform(anchors, lambda a: F.xxhash64(a, *words)))

    def starts(position, k):
        # positions count from 1, so those of unbroken content words differ by the number between
        run = F.when(k < far, position == k + 1).otherwise(position - F.get(F.col(at), k - far) == far)
        chained = [F.get(F.col(w), F.get(F.col(at), k + j) - 1) for j in range(chain + 1)]
        return F.when(run & (k < last), F.xxhash64(*chained))

    found = F.flatten(F.filter(F.transform(at, spots), lambda x: x.isNotNull()))
    if far is not None:
        found = F.concat(found, F.filter(F.transform(at, starts), lambda x: x.isNotNull()))
    found = F.sort_array(F.array_distinct(found))
    if far is None:
        return df.withColumn(out, found).drop(w, at)
    df = df.withColumn(out, found)
    return df.withColumn(out, F.when((F.size(out) == 0) & (F.char_length(text) > 0), F.array(F.xxhash64(text))).otherwise(F.col(out))).drop(w, at)


def fingerprint(found: Column) -> Column:
    """The set of signatures as text: 16 hexadecimal digits each, in order."""
    return F.array_join(F.transform(found, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def likeness(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard coefficient of two signature sets; 0 if their lengths show it is below ``least``."""
    m, n = F.size(a), F.size(b)
    both = F.size(F.array_intersect(a, b))
    return (
        F.when((m == 0) & (n == 0), F.lit(1.0))
        .when(F.least(m, n) < F.greatest(F.greatest(m, n) * F.lit(least), F.lit(1)), F.lit(0.0))
        .otherwise(both / (m + n - both))
    )


def with_next(docs: DataFrame, far: int | None = None) -> DataFrame:
    """(doc_id, text, spots, next_text, next_spots): each row with the next in descending id order.

    The last row's next is the first.  One shuffle of the texts, by bucket of the id.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ranges = IdRanges(rows, "doc_id", ROWS_PER_BUCKET, MAX_BUCKETS)
    # descending, null ids last
    rows = ranges.with_bucket(rows, "__bucket").withColumn("__bucket", F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(-F.col("__bucket") - 1).cast("long"))
    # MAX_BUCKETS rows at most
    tops = rows.groupBy("__bucket").agg(F.max("doc_id").alias("__top"))
    order = Window.orderBy("__bucket")
    final = F.max("__bucket").over(Window.partitionBy())
    tops = tops.withColumn("__to", F.coalesce(F.lag("__bucket").over(order), final))
    rows = rows.join(F.broadcast(tops), "__bucket")
    own = F.struct(F.col("__bucket").alias("b"), F.lit(0).alias("copy"))
    copy = F.struct(F.col("__to").alias("b"), F.lit(1).alias("copy"))
    places = F.when(F.col("doc_id").eqNullSafe(F.col("__top")), F.array(own, copy)).otherwise(F.array(own))
    rows = rows.select("doc_id", "text", F.explode(places).alias("__place")).select("doc_id", "text", "__place.b", "__place.copy")
    rows = with_signatures(rows.repartition("b"), "text", "spots", far=far)
    following = Window.partitionBy("b").orderBy("copy", F.desc_nulls_last("doc_id"), "text")
    rows = rows.withColumn("next_text", F.lead("text").over(following)).withColumn("next_spots", F.lead("spots").over(following))
    return rows.where("copy = 0").drop("b", "copy")


def edited_fingerprints(docs: DataFrame, far: int | None = None) -> DataFrame:
    """Fingerprints of every text and of the text with its second half taken from the next document."""
    rows = with_next(docs, far)
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.withColumn("n_chars", n.cast("long")).withColumn("edited", F.concat(F.left("text", n - half), F.left("next_text", half)))
    rows = with_signatures(rows.drop("text", "next_text"), "edited", "edited_spots", far=far)
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(F.col("spots")).alias("fingerprint"),
        fingerprint(F.col("edited_spots")).alias("edited_fingerprint"),
        likeness(F.col("spots"), F.col("edited_spots")).alias("near_edited"),
        likeness(F.col("spots"), F.col("next_spots")).alias("near_next"),
    )


def similar_pairs(docs: DataFrame, least: float = 0.8, far: int | None = None) -> DataFrame:
    """(a, b, likeness): pairs of ids whose signature sets have ``least`` likeness or more.

    Equal sets are first reduced to their least id (null only if all are), so copies give no
    pairs.  Ids needn't be unique: sets, not ids, are compared, so ``a`` and ``b`` may be equal
    or null.  ``a`` is the lesser id, null last.  With ``far`` texts without listed words have
    sets too; texts whose set is empty have no pairs.

    Sets go to partitions by length: a partition is as wide as ``least`` allows, so partners
    are in the same or the next one.  A pair is compared only where the rarest signatures of
    both, as many as ``least`` allows to differ plus one, have one in common.
    """
    sets = with_signatures(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "text", "spots", far=far).where("size(spots) > 0")
    sets = sets.groupBy("spots").agg(F.min("doc_id").alias("doc_id")).withColumn("n", F.size("spots"))
    # null fields of a key would not be equal to one another in joins
    key = F.struct(F.col("doc_id").isNull().alias("last"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64("spots").alias("hash"))
    sets = materialize(sets.withColumn("key", key), "signature-sets")
    spots = sets.select("key", "n", F.explode("spots").alias("spot"))
    count = spots.groupBy("spot").agg(F.count(F.lit(1)).alias("df"))
    rarest = Window.partitionBy("key").orderBy("df", "spot")
    # signatures that no other set has are the rarest, so they come first and are numbered too
    prefix = spots.join(count, "spot").withColumn("nth", F.row_number().over(rarest))
    prefix = prefix.where((F.col("nth") <= F.col("n") - F.ceil(F.col("n") * F.lit(least) - 1e-9) + 1) & (F.col("df") > 1))
    cell = F.floor(F.log(F.col("n").cast("double")) / -F.log(F.lit(least)))
    prefix = materialize(prefix.select("key", "n", "spot", cell.alias("cell")), "rarest-signatures")
    left = prefix.select(F.col("key").alias("x_key"), F.col("n").alias("m"), "spot", F.explode(F.array(*[F.col("cell") + k for k in (-1, 0, 1)])).alias("cell"))
    right = prefix.select(F.col("key").alias("y_key"), "n", "spot", "cell")
    close = (F.col("x_key") < F.col("y_key")) & (F.least("m", "n") >= F.greatest("m", "n") * F.lit(least) - 1e-9)
    pairs = left.join(right, ["spot", "cell"]).where(close).select("x_key", "y_key").distinct()
    x, y = (sets.select(F.col("key").alias(f"{k}_key"), F.col("doc_id").alias(name), F.col("spots").alias(k)) for k, name in (("x", "a"), ("y", "b")))
    found = pairs.join(x, "x_key").join(y, "y_key").select("a", "b", likeness(F.col("x"), F.col("y")).alias("likeness"))
    return found.where(F.col("likeness") >= least)
