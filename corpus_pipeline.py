"""A training-data pipeline of five operators: quality, near duplicates, repeated passages, source mix, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the docs of the
next stage. All but the last return the columns of documents. Part of the subpackage for language-model data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lostfound.llm import compression, minhash, mixing, packing, suffixes
from lostfound.llm.common import count_words, fresh_names, scratch, table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier rejects go; null and blank texts have the share of good rows as score and stay with it."""
    model = compression.fit(docs, table(spark, sf_dir, "labels"))
    # stored here, as few texts at once go to Python while a table is stored
    return written(compression.score(docs, model).filter("predicted = 1").select(*docs.columns), "kept")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by shingles of five words and a similarity of 0.8, the document with the smallest id stays. Rows that repeat an id stay or go together; a null id stays."""
    gone = minhash.near_duplicates(docs.select("doc_id", "text"), size=5, percent=80).filter("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that an earlier document has are cut from the later ones; no document goes."""
    done = suffixes.clean(docs.select("doc_id", "text", *[c for c in docs.columns if c not in ("doc_id", "text")]))
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.length("text").cast("long"))
    return written(done.select(*docs.columns), "cleaned")


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it. Rows that repeat an id are counted one by one: the takes of an id are dealt to its rows of a size in order of source and text."""
    id_, size, all_, most, place, copy = fresh_names(docs, "id", "size", "all", "most", "place", "copy")
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)).cast("long"))
    repeats = mixing.mix(docs.select("doc_id", "text", "source")).select(key.alias(id_), F.col("size").alias(size), "repeats").filter("repeats > 0")
    taken = written(repeats.groupBy(id_, size).agg(F.sum("repeats").alias(all_), F.max("repeats").alias(most)), "mix-taken")
    # texts are shuffled once: the window has the partitions of the join
    joined = docs.withColumn(id_, key).withColumn(size, count_words(F.col("text"))).join(taken, [id_, size])
    ranked = joined.withColumn(place, F.row_number().over(Window.partitionBy(id_, size).orderBy("source", "text")))
    own = F.least(F.col(most), F.col(all_) - (F.col(place) - 1) * F.col(most))
    return ranked.withColumn(copy, F.explode(F.sequence(F.lit(1), F.when(own > 0, own).cast("int")))).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their ids, compressed, and their places in the sequences. A null text is a piece of the closing id alone."""
    return packing.pack_documents(docs, ids="zstd")


STAGES = [
    ("quality_classifier", quality),
    ("minhash_near_dedup", near_duplicates),
    ("suffix_array_dedup", repeated_passages),
    ("source_mixing", source_mix),
    ("best_fit_packing", packed),
]

#: The classifier, the mix and the tokenizer are beyond SQL; tests/llm holds each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
