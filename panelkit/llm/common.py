"""Helpers shared by the corpus operators: words, shared storage, id ranges."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words, as a regular expression class body.
SPACE = r"\x20\x09-\x0D"
#: Spark's bound on the bytes of an Arrow batch.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def words(text: Column) -> Column:
    """Array of maximal runs without white space; null text gives an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), "")


def count_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset a temporary folder is set, which is only right on a local
    master; a cluster without the setting is an error.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    found = "file://" + tempfile.mkdtemp(prefix="panelkit-")
    spark.conf.set("spark.checkpoint.dir", found)
    sc.setCheckpointDir(found)
    return found


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, codec: str = "zstd", batch_bytes: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage: what an executor loses later is read again, not computed
    again, and results used twice are computed once.  With ``batch_bytes``, Arrow batches
    that go to Python meanwhile hold about so many bytes; by default Spark sends up to 64 MB.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    before = spark.conf.get(BATCH_BYTES)
    if batch_bytes is not None:
        spark.conf.set(BATCH_BYTES, str(batch_bytes))
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        if batch_bytes is not None:
            spark.conf.set(BATCH_BYTES, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table that ``materialize`` wrote, once nothing reads it any more."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    name = "__" + name
    while name.lower() in map(str.lower, df.columns):
        name += "_"
    return name


def batch_rows(batches: Iterator[pa.RecordBatch], *columns: str):
    """Python lists of the named columns of each Arrow batch."""
    for batch in batches:
        yield [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in columns]


def by_size(batches: Iterator[pa.RecordBatch], column: str, limit: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """The batches in parts of about ``limit`` bytes of a text column, at least a row each.

    Spark counts rows of a batch, whatever their size; what Python makes of a part is bounded.
    What the task has freed goes back to the system at its end, as workers stay for later tasks.
    """
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        ends = np.append(np.flatnonzero(np.diff(size // limit)) + 1, len(size)).tolist()
        for start, end in zip([0, *ends], ends):
            yield batch.slice(start, end - start)
        del batch
    give_back()


def give_back() -> None:
    """Return freed memory of this process to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's alone
    if trim is not None:
        trim(0)


def crc_mod(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null stays null."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


class IdRanges:
    """Order-preserving buckets of a whole-number id column with about equal row counts.

    Borders are quantiles of the ids, however these are spread, found in two levels: up to
    ``RANGES`` ranges of all ids, then as many parts of each range as its rows ask for.
    Beyond ``max_buckets`` buckets get larger.  Sketches of bounded size and the borders are
    all that leaves the tasks.  ``with_bucket`` adds numbers that never decrease with the id;
    equal ids share a bucket, null ids get the last one.

    Quantiles are counted in double precision, so beyond 2^53 borders lie as far apart as
    doubles do, up to 1024 ids; ids are compared with them as they are.
    """

    RANGES = 1024
    #: Ranks are right to one in this many of a range.
    ACCURACY = 16
    #: Parts of a range are less than this.
    STEP = 1 << 20

    def __init__(self, df: DataFrame, column: str, rows_per_bucket: int, max_buckets: int = 1 << 18, ranges: int = RANGES):
        self.column = column
        ids = df.select(F.col(column).cast("long").alias("id")).where("id is not null")
        at = F.percentile_approx("id", [k / ranges for k in range(1, ranges)], ranges * self.ACCURACY)
        cuts, self.rows = ids.agg(at, F.count(F.lit(1))).first()
        wanted = max(rows_per_bucket, -(-self.rows // max_buckets))
        each = max(self.rows / ranges, 1e-9)
        # ranges that hold less than a bucket are put together
        self.cuts = sorted(set((cuts or [])[:: max(1, int(wanted / each))]))
        self.last = (len(self.cuts) + 1) * self.STEP
        parts = min(-int(-each // wanted), self.STEP)
        self.inner = None
        if parts > 1:
            inner = F.percentile_approx("id", [k / parts for k in range(1, parts)], parts * self.ACCURACY)
            inner = ids.groupBy(self._above(F.col("id"), F.lit(self.cuts).cast("array<long>"), len(self.cuts)).alias("__range")).agg(inner.alias("__cuts"))
            # a row for each range, max_buckets borders in all; stored, as sketches differ from run to run
            self.inner = materialize(inner.withColumn("__cuts", F.array_distinct("__cuts")), "id-borders")
        self.parts = parts

    @staticmethod
    def _above(x: Column, cuts: Column, most: int) -> Column:
        """How many of the sorted ``cuts``, ``most`` or fewer, are ``x`` or less, by bisection."""
        if most == 0:
            return F.lit(0)
        steps = F.array(*[F.lit(1 << k) for k in reversed(range(most.bit_length()))])
        return F.aggregate(steps, F.lit(0), lambda n, step: F.when(F.get(cuts, n + step - 1) <= x, n + step).otherwise(n))

    def with_bucket(self, df: DataFrame, name: str) -> DataFrame:
        x = F.col(self.column).cast("long")
        df = df.withColumn("__range", self._above(x, F.lit(self.cuts).cast("array<long>"), len(self.cuts)))
        part = F.lit(0)
        if self.inner is not None:
            df = df.join(F.broadcast(self.inner), "__range", "left")
            part = F.coalesce(self._above(x, F.col("__cuts"), self.parts), F.lit(0))
        bucket = F.when(x.isNull(), F.lit(self.last)).otherwise(F.col("__range") * self.STEP + part).cast("long")
        return df.withColumn(name, bucket).drop("__range", "__cuts")
