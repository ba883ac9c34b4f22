"""A training-data pipeline over `documents`: five stages, each an operator of fieldglass.llm on what the stage before kept.

Every stage reads whole texts of all its rows. A null text counts as empty, a null id, language or source is a value of its own;
columns beside those of `documents` are kept, whatever their names; no rows give no rows. What a stage makes of empty and very long
texts, ties and repeated rows is said where it stands.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fieldglass.llm import exact_dedup, minhash, mixing, quality, sentencepiece_codec
from fieldglass.llm.common import stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    Empty texts and texts of fewer than 50 words go, however often they stand; repeated rows share one verdict, and all of them
    stay or go. A very long text is counted like any other.
    """
    return quality.keep_good(docs).select(docs.columns)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose texts are equal, the one with the largest id.

    Rows that repeat the largest id and its text are left once. If all ids of equal texts are null, all these rows stay.
    """
    return exact_dedup.drop_copies(docs).select(docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8 or more: that with the smallest id.

    A text of fewer words is one shingle; texts without words, and rows without an id, are linked with nothing and stay. Rows
    that share an id are one document.
    """
    return minhash.keep_one(docs).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target weight asks for: none, once, twice or three times.

    A text without words takes nothing of a target and stays as often as the whole part of its source's rate. Rows that repeat
    an id and a text are rounded together. The same documents give the same choice, whatever their order.
    """
    return mixing.mixed(docs).select(docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with checks of decoding and parity: doc_id, n_tokens, ids, round_trip, parity.

    An empty text has no ids. Repeated rows are encoded each; a very long text is encoded whole.
    """
    import public_tokenizers

    return sentencepiece_codec.encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [("quality", quality_rules), ("exact_dedup", exact_copies), ("near_dedup", near_copies), ("mix", mix_sources), ("tokenize", tokenize)]

#: Robust estimates and random rounding aren't expressible in SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
