"""The corpus pipeline: five stages over documents, each written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import exact_dedup, jaccard_join, packing, quality, recompression
from tidemark.llm.common import Scratch, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality rules keep. A null or empty text has no words and goes; repeated rows share their verdict; other columns go."""
    return quality.quality(docs.select(*COLUMNS)).filter("kept").select(*COLUMNS)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for the case of A-Z, the one with the largest doc_id; of a row given twice, one. Null counts as empty, a null id is behind all others."""
    return exact_dedup.drop_exact_copies(docs.select(*COLUMNS))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of similarity 0.75 or more over five-word shingles connect, the one with the smallest doc_id.

    A null or empty text is linked with nothing and stays. Rows with one id are one document and share their fate.
    """
    found = jaccard_join.near_copies(docs).select(F.col("doc_id").alias("id"), "component_id")
    stay = written(found.filter("id <=> component_id").select("id"), "stay")
    return docs.select(*COLUMNS).join(stay, F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")


def drop_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each text without the words of 35-word windows that also start elsewhere; a text that loses words is joined by single spaces, one that loses all goes.

    A null or empty text goes too. Rows that share an id are told apart by nothing here; the stages before leave one row per id where ids are unique.
    """
    scratch = Scratch(spark)
    found = recompression.drop_repeats(docs, scratch=scratch).filter("n_removed > 0").select(F.col("doc_id").alias("id"), "kept")
    found = written(found, "shortened")
    scratch.remove()
    out = docs.select(*COLUMNS).join(found, F.col("doc_id").eqNullSafe(F.col("id")), "left").withColumn("text", F.coalesce("kept", "text"))
    return out.filter("text <> ''").withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts' tokens in sequences of at most 1024, a row per piece; an empty table gives no rows, a null text its end id alone."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", keep_quality),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("substring dedup", drop_passages),
    ("best-fit packing", pack_sequences),
]

#: Token ids and the search for links are beyond SQL; tests/llm hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
