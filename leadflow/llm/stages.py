"""The pipeline's stages: (spark, docs, sf_dir) to documents, the last one to packed pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadflow.llm.common import bounded_batches, table
from leadflow.llm.decontam import drop_contaminated
from leadflow.llm.neardup import Settings, drop_near_duplicates
from leadflow.llm.packing import pack
from leadflow.llm.pii import mask_pii
from leadflow.llm.quality import fit, held_out, keep_good


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.7 or more."""
    bounded_batches(spark)
    return keep_good(docs, fit(docs, table(spark, sf_dir, "labels").filter(~held_out())))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, by five-word shingles at a similarity of 0.8."""
    bounded_batches(spark)
    return drop_near_duplicates(docs, settings=Settings(words=5))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without ten words in a row of a benchmark item."""
    bounded_batches(spark)
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"), window=10)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data masked, their lengths counted anew."""
    masked = mask_pii(docs)
    return masked.withColumn("n_chars", F.char_length("text").cast(masked.schema["n_chars"].dataType))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token windows."""
    bounded_batches(spark)
    import public_tokenizers

    # the executors' memory has grown over four stages by now
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), slice_bytes=2_000_000, cached_words=200_000)
