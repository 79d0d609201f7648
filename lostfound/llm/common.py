"""What the operators share: words, scratch tables, ranks inside groups, label folds."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
WORDS = re.compile(WORD)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a new local one if driver and executors are one process (tests); an error otherwise."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/llm-{spark.sparkContext.applicationId}"


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex[:12]}"


#: Tables of :func:`written` and their folders.
_folders: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
#: Spark frees the shuffle files of a query at its end while this is on.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows that go to Python at once; whole texts go there, so they are fewer than Spark's own 10,000.
PYTHON_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Bytes that go to Python at once, or one row if it is longer.
PYTHON_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Rows of a partition that the driver sees to choose the bounds of ranges.
RANGE_ROWS = "spark.sql.execution.rangeExchange.sampleSizePerPartition"
#: Bytes of a row group of stored tables, which a task holds while it writes.
BLOCK_BYTES = 32 << 20
STORING = {FREE_SHUFFLES: "true", PYTHON_ROWS: "2000", PYTHON_BYTES: str(4 << 20), RANGE_ROWS: "20"}


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written to the shared folder and read again: computed once, and safe when executors are lost. Its shuffle files go at once."""
    spark = df.sparkSession
    path = scratch(spark, tag)
    before = {k: spark.conf.get(k) for k in STORING}
    for k, v in STORING.items():
        spark.conf.set(k, v)
    try:
        df.write.option("compression", "zstd").option("parquet.block.size", BLOCK_BYTES).parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    _folders[out] = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes tables of :func:`written` that no later job reads."""
    for df in tables:
        path = _folders.pop(df, None)
        if path:
            spark = df.sparkSession
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def tidied(f: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function over the batches of a task that gives free memory back to the system when it ends: Python workers wait for later tasks with what they once took."""

    def run(batches: Iterator) -> Iterator:
        try:
            yield from f(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return run


def fresh_names(df: DataFrame, *names: str) -> list[str]:
    """Column names made from ``names`` that ``df`` doesn't have, nor any name that begins with them."""
    taken = [c.lower() for c in df.columns]
    mark = "_"
    while any(c.startswith(mark + n.lower()) for c in taken for n in names):
        mark += "_"
    return [mark + n for n in names]


def n_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(folds)


def count_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def rank_within(df: DataFrame, keys: list[str], order: list[str], seed: int = 0) -> DataFrame:
    """Adds ``_rank`` (long, from 0 without gaps) inside each group of ``keys``.

    No task holds a whole group: rows are dealt to salts by a hash of ``order`` (so the salt comes first in
    the ranking), ranked inside (keys, salt), and moved by the number of rows in the salts before. The keys
    must not be null.
    """
    salts = max(8, n_parts(df.sparkSession))
    salted = df.withColumn("_h", F.xxhash64(F.lit(seed), *order)).withColumn("_salt", F.pmod("_h", F.lit(salts)))
    w = Window.partitionBy(*keys).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    before = salted.groupBy(*keys, "_salt").agg(F.count("*").alias("_n")).select(*keys, "_salt", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys, "_salt").orderBy("_h", *order)
    return salted.join(before, [*keys, "_salt"]).withColumn("_rank", (F.row_number().over(inside) - 1 + F.col("_before")).cast("long")).drop("_h", "_salt", "_before")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, *, doc_id: str, text: str, folds: int, class_rows: int) -> tuple[DataFrame, dict[int, int]]:
    """(rows ``_id, _t, _y`` to learn from, number of all labelled rows by class).

    Of each class the ``class_rows`` rows outside fold 0 with the smallest hash of the text, equal texts once. Only ids and hashes
    are shuffled for the choice; the ids and hashes chosen, 2 x class_rows at most, then pick the texts by a broadcast. Rows with a null
    text, id or label take no part; of an id with several labels the smallest counts, and each of its texts is a row of its own.
    """
    spark = docs.sparkSession
    marked = labels.filter(F.col(doc_id).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(doc_id).alias("_id")).agg(F.min(F.col(label).cast("int")).alias("_y"))
    own = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_t")).filter((fold(F.col("_id"), folds) != 0) & F.col("_t").isNotNull()).withColumn("_h", F.xxhash64(F.lit(11), "_t"))
    known = written(own.select("_id", "_h").join(marked, "_id"), "labelled")
    shares = {r["_y"]: r["n"] for r in known.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    once = known.groupBy("_y", "_h").agg(F.min("_id").alias("_id"))
    ids = [(r["_id"], r["_h"], y) for y in (0, 1) for r in once.filter(F.col("_y") == y).orderBy("_h").limit(class_rows).collect()]
    forget(known)
    chosen = spark.createDataFrame(ids, "_id long, _h long, _y int")
    return (own.join(F.broadcast(chosen), ["_id", "_h"]).dropDuplicates(["_id", "_h"]) if ids else own.limit(0).withColumn("_y", F.lit(0))).select("_id", "_t", "_y"), shares
