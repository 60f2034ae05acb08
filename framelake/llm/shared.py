"""What the training-data operators have in common: the shared folder, written
intermediate tables, word boundaries and names that cannot clash."""

from __future__ import annotations

import atexit
import contextlib
import os
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The white space of every word contract here: space and U+0009 to U+000D.
SPACE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where the session names none (tests, a single machine) a local folder
    is taken, and then only with a local master.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if found:
        return found
    if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):  # local-cluster has executors apart
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    local = os.path.join(tempfile.gettempdir(), "checkpoints")
    sc.setCheckpointDir(local)
    return local


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it again.

    This cuts the lineage: a lost executor costs a re-read, not a recomputation.
    The table is removed when the driver's Python ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/framelake-{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


#: Rows of whole texts that a task holds at once on their way to Python, and the
#: settings that say so. Spark's own, 10,000 and 4096, keep some 33 MB of documents of
#: 3.3 KB in each of several buffers, which grow by doubling outside the heap.
BATCH_ROWS = 512
BATCHES = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize")


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> Iterator[None]:
    """What is written inside takes at most `rows` rows a batch; a session's own
    smaller settings stay, and all are as before afterwards. Batches say nothing
    about results: no operator depends on where one ends."""
    found = {name: spark.conf.get(name, None) for name in BATCHES}
    try:
        for name in BATCHES:
            if not 0 < int(spark.conf.get(name)) <= rows:  # zero or less: no limit
                spark.conf.set(name, str(rows))
        yield
    finally:
        for name, before in found.items():
            if before is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, before)


def discard(df: DataFrame) -> None:
    """Remove a written table that nothing reads any more."""
    _remove(df.sparkSession, df._written_to)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the JVM may have ended before the driver's Python  # noqa: BLE001
        pass


def place(df: DataFrame) -> Column:
    """A name for each row that is the same in every scan of the same files: the file
    and the row's number in it. It does not depend on how files are split, which
    follows the executors that are there. Only a table that is not read from Parquet
    (a test's) gets numbers that hold for one plan."""
    try:
        df.select("_metadata.file_path", "_metadata.row_index").schema  # noqa: B018
    except AnalysisException:
        return F.monotonically_increasing_id()
    return F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))


def running(df: DataFrame, group: list[str], order: list[str], sums: dict[str, str]) -> DataFrame:
    """Add, for each column of `sums` (name: new name), its sum over the rows of the
    same `group` that come before by `order`, null first.

    No group meets in one task: rows are range-partitioned, rows alike in all of
    these by a row number, so that a hot key spreads; each partition has sums of its
    own, and the partitions' totals, a few rows each, are summed in turn. Rows alike
    in group and order follow each other in any order. Written on the way.
    """
    by = [*group, *order]
    serial, part = free_name(df, "serial"), free_name(df, "part")
    there = written(df.withColumn(serial, F.monotonically_increasing_id()), "rows")  # a lost task finds the same numbers
    there = there.repartitionByRange(*by, serial).sortWithinPartitions(*by, serial)
    there = written(there.withColumn(part, F.spark_partition_id()).withColumn(serial, F.monotonically_increasing_id()), "sorted")
    totals = there.groupBy(*group, part).agg(*[F.sum(c).alias(n) for c, n in sums.items()])
    earlier = Window.partitionBy(*group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    totals = written(totals.select(*group, part, *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(n) for n in sums.values()]), "totals")
    inside = Window.partitionBy(*group, part).orderBy(serial).rowsBetween(Window.unboundedPreceding, -1)
    own = {n: free_name(df, f"own_{n}") for n in sums.values()}
    out = there.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(own[n]) for c, n in sums.items()])
    out = out.join(totals, [*group, part])
    return out.select(*df.columns, *[(F.col(n) + F.col(own[n])).alias(n) for n in sums.values()])


#: Parts into which a hot key is spread.
SALTS = 64


def salt(*columns: str) -> Column:
    """A number below SALTS by which rows of one key are told apart in a join."""
    return F.pmod(F.xxhash64(*columns), F.lit(SALTS)).cast("int")


def salt_of(*columns: str) -> Column:
    """A row's salt as a bit."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), salt(*columns))


def salt_bit(*columns: str) -> Column:
    """Aggregate: a bit for each salt that a group's rows have."""
    return F.bit_or(salt_of(*columns))


def salts(bits: str) -> Column:
    """The salts of a salt_bit, as an array. A table of one row a key, repeated for
    these, meets each row of the other side once; none of its rows is in vain, and no
    key's rows come to one task."""
    return F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda k: F.call_function("getbit", F.col(bits), k) == 1)


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that df does not have (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    name, n = f"_{stem}", 0
    while name.lower() in taken:
        n += 1
        name = f"_{stem}{n}"
    return name


def text_of(column: str | Column) -> Column:
    """The text, an empty one for null."""
    return F.coalesce((F.col(column) if isinstance(column, str) else column).cast("string"), F.lit(""))


def slices(texts: Iterable[str | None], most: int = 4 << 20) -> Iterator[list[str]]:
    """Consecutive lists of whole texts of about `most` characters, so that
    arrays over a batch stay bounded; a longer text comes alone."""
    held: list[str] = []
    size = 0
    for text in texts:
        text = text or ""
        if held and size + len(text) > most:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held


def encoded(text: str) -> bytes:
    """UTF-8; a lone surrogate, which no valid table holds, becomes '?'."""
    return text.encode("utf-8", "replace")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
