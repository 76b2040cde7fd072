"""A corpus pipeline: toxic documents go, near copies go, repeated passages go, sources are mixed, tokens are packed.

Each stage takes (spark, docs, sf_dir), works on all its predecessor kept and returns the columns of documents, the last
one the pieces of packed sequences. Stages are written as Parquet and read again in between.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridsignal.llm import jaccard, mixing, packing, substrings, toxicity
from gridsignal.llm.labelled import fold
from gridsignal.session import written

#: Ids that are sent to all tasks at most (8 MB); more are joined by shuffling both sides.
BROADCAST_ROWS = 1_000_000
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go; all others stay as they are. The held-out fold doesn't train."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels, fold(F.col("doc_id"), 3) != 1)
    return toxicity.keep_accepted(docs.select(*COLUMNS), model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by shingles (five words, similarity 0.8) one row stays: one with the smallest id, null last.

    Rows go by id and digest of the text, so ids may repeat or be null. Texts without words are linked with nothing and
    all stay, repeated rows included.
    """
    docs = docs.select(*COLUMNS)
    named = jaccard.with_digest(docs, "doc_id", "text")
    texts = written(jaccard.text_components(named, n=5, p=4, q=5).filter("size > 0").select("copy_of", "group"))
    rows = written(named.select("id", "copy_of").join(texts, "copy_of").groupBy("group", "id", "copy_of").agg(F.count(F.lit(1)).alias("n")))
    first = rows.groupBy("group").agg(F.min(F.struct("id", "copy_of")).alias("first"), F.count(F.lit(1)).alias("kinds"))
    # groups of one row lose nothing
    stays = F.struct("id", "copy_of") == F.col("first")
    marked = rows.join(first, "group").filter("kinds > 1 OR n > 1").select("id", "copy_of", stays.alias("stays"), "n")
    marked = written(marked.filter("NOT stays OR n > 1").select("id", "copy_of", "stays"))
    if marked.count() <= BROADCAST_ROWS:
        marked = F.broadcast(marked)
    keyed = docs.withColumn("id", F.coalesce("doc_id", F.lit(jaccard.NO_ID))).withColumn("copy_of", F.md5(F.coalesce("text", F.lit(""))))
    placed = keyed.join(marked, ["id", "copy_of"], "left")
    once = placed.filter("stays").dropDuplicates(["id", "copy_of"])
    return placed.filter("stays IS NULL").unionByName(once).select(*COLUMNS)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that repeat go from the texts; documents with nothing left go too, others keep their lines."""
    kept = substrings.remove_repeats(docs.select(*COLUMNS))
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    changed = kept.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long"))
    return changed.filter((F.col("n_words") == F.lit(0)) | (F.col("n_removed") < F.col("n_words"))).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix's documents: one row for each epoch in which words of a document are taken, with these words as text."""
    return mixing.mixed_documents(docs.select(*COLUMNS), [3.0, 1.0, 2.0], 1.5)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens."""
    return packing.pack_documents(docs, packing.default_tokenizer())


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("substring_dedup", drop_repeated_passages),
    ("source_mixing", mix_sources),
    ("packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the table documents. Intermediate results go to the checkpoint folder, which executors share."""
    from gridsignal.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    folder = os.path.join(spark.sparkContext.getCheckpointDir(), f"pipeline-{uuid.uuid4().hex}")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
