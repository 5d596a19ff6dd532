"""From raw documents to packed training sequences, one operator per stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyhive.llm.common import fresh_path, prepare, table
from skyhive.llm.packing import pack
from skyhive.llm.quality import kept
from skyhive.llm.simhash import without_copies
from skyhive.llm.substrings import remove_repeats


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (low quality or toxic) go."""
    return kept(docs, table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: SimHash links by covering, and bands for pairs further apart, all
    checked on the sets of five-word shingles (similarity 0.8 or more)."""
    return without_copies(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of 35-word passages that occur more than once go; n_chars follows the text."""
    cut = remove_repeats(docs)
    columns = {"doc_id": F.col("doc_id"), "text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return cut.select(*(columns.get(c, F.col(f"rest.`{c}`")).alias(c) for c in docs.columns))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document in sequences of at most 2,048 ids."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", quality), ("near_copies", near_copies), ("repeated_passages", repeated_passages), ("packing", packing)]

#: The stages learn, hash and solve a linear program: SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each but the last is written to the shared folder and read again."""
    docs = table(prepare(spark), sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = fresh_path(spark, f"stage-{name}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
