"""Token counts through a cache of digests: only texts not counted before are encoded."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

#: Columns of a cache: digests of a tokenizer's version and of a text, and the count.
CACHE = "tokenizer string, digest string, n_tokens long"
#: Characters given to the library at once.
BATCH_CHARS = 1 << 20


def tokenizer_version(path: str) -> str:
    """Digest of the tokenizer's file: another file never meets the counts of this one."""
    with open(path, "rb") as file:
        return hashlib.sha256(file.read()).hexdigest()


def normalised(text: Column) -> Column:
    """Content that is counted: the text as it is, null as empty; anything more could change counts."""
    return F.coalesce(text.cast("string"), F.lit(""))


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(CACHE).parquet(path)
    except AnalysisException:  # nothing has been stored there yet
        return spark.createDataFrame([], CACHE)


def _loaded(path: str):
    """A function from texts to token counts, for a file of the tokenizers or sentencepiece library."""
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        return lambda texts: [len(e) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda texts: [len(ids) for ids in processor.encode(texts, num_threads=1)]


def _groups(texts: list[str]):
    first, held = 0, 0
    for k, text in enumerate(texts):
        held += len(text)
        if held >= BATCH_CHARS:
            yield texts[first:k + 1]
            first, held = k + 1, 0
    if first < len(texts):
        yield texts[first:]


def _encoder(path: str):
    def encoded(batches):
        count = _loaded(path)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            counts = [n for group in _groups(texts) for n in count(group)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("digest"), pa.array(np.array(counts, np.int64))], names=["digest", "n_tokens"])

    return encoded


def count_tokens(docs: DataFrame, tokenizer: str, cache: str) -> DataFrame:
    """All columns of docs but text, plus n_bytes (UTF-8), digest and n_tokens of every whole text.

    docs: doc_id, text and any others; columns named like the new ones are replaced. tokenizer: a file
    that every executor can open. cache: a folder that all executors share; counts of new texts are
    appended to it before this returns, so the next run finds them.

    Each distinct digest that the cache lacks is encoded once, from one of its rows, wherever its
    copies are. Texts travel once, to their digest's place; everything else moves digests only. A null
    text is empty and has no tokens. Repeated rows stay. An empty table appends nothing. Should two
    runs count the same text at the same time, the cache holds it twice, with equal counts.
    """
    spark = docs.sparkSession
    version = F.lit(tokenizer_version(tokenizer))
    text = normalised(F.col("text"))
    keyed = docs.drop("n_bytes", "digest", "n_tokens").withColumn("digest", F.sha2(text, 256))
    stored = read_cache(spark, cache).filter(F.col("tokenizer") == version)
    misses = (keyed.select("digest", text.alias("text"))
              .join(stored.select("digest"), "digest", "left_anti")
              .dropDuplicates(["digest"]))
    misses.mapInArrow(_encoder(tokenizer), "digest string, n_tokens long").select(
        version.alias("tokenizer"), "digest", "n_tokens").write.mode("append").parquet(cache)
    known = read_cache(spark, cache).filter(F.col("tokenizer") == version).groupBy("digest").agg(
        F.max("n_tokens").alias("n_tokens"))
    sized = keyed.withColumn("n_bytes", F.octet_length(text).cast("long")).drop("text")
    return sized.join(known, "digest", "left").select(*sized.columns, "n_tokens")
