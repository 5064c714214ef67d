"""A cleaning pipeline over ``documents``: language ID, exact, near and substring deduplication, packing.

Each stage is one operator of craterloom.llm over all that the stage before kept, and is written as
Parquet before the next one reads it.  All but the last return the columns of ``documents``.

1. language_id: a classifier is fitted on the labelled rows of the stage's own input.  Rejected are
   texts without a letter and those whose score is below MIN_SCORE; a null lang is filled in.
2. exact_dedup: of equal texts the row with the largest doc_id stays.
3. near_dedup: of each component of texts with 80 of 100 five-word shingles in common the row with
   the smallest doc_id stays.
4. substring_dedup: every byte that lies in a repeated 200-byte string goes; no row goes.
5. pack: what remains, tokenized, in sequences of 4096 ids.  The rows are pieces with their ids
   (``ids``: little-endian unsigned 32-bit integers), their sequence and their place in it.

Defined results
---------------
* A null doc_id is a row like any other: it is never learned from, loses to any other id of an exact
  copy, and in near_dedup stays if all ids of its component are null.
* A null or empty text, or one without a letter, goes at the first stage.  A null lang becomes the
  predicted one; null source or n_chars stay null until substring_dedup counts n_chars anew.
* Very long texts are read whole in every stage.  A text that loses all its bytes stays as an empty one
  and is packed as its end id alone.
* Repeated rows are exact copies: one stays.  Ties are settled by doc_id as the stages say.
* An empty table gives no rows.  Columns besides documents' own go along unchanged through stages 1
  to 4, also if they are named like a column that a stage makes (``score``, ``lang_pred``, ``n_bytes``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from craterloom.llm import exact_dedup, langid, near_dedup, packing, suffix_array
from craterloom.llm.chunks import tokenizer_path
from craterloom.llm.core import written

MIN_SCORE = 0.2

#: No DuckDB SQL can say what these stages do; tests hold each of them against brute force.
ORACLE_SQL = None


def _apart(docs: DataFrame) -> tuple[DataFrame, dict[str, Column]]:
    """doc_id, text and all other columns in one, so that no name meets a stage's own; and where each column is then."""
    names = [c for c in docs.columns if c != "text"]
    others = F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names))).alias("others")
    return docs.select("doc_id", "text", others), {c: F.col(f"others.c{i}") for i, c in enumerate(names)} | {"text": F.col("text")}


def _together(rows: DataFrame, place: dict[str, Column], columns: list[str]) -> DataFrame:
    return rows.select(*(place[c].alias(c) for c in columns))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, place = _apart(docs)
    named = langid.identify(rows, langid.train(docs.select("doc_id", "text", "lang")))
    kept = named.where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_SCORE))
    return _together(kept, place | {"lang": F.coalesce(place["lang"], F.col("lang_pred"))}, docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_exact(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.drop_near(docs, width=5, percent=80)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, place = _apart(docs)
    kept = suffix_array.remove_repeats(rows)
    return _together(kept, place | {"text": F.when(F.col("text").isNotNull(), F.col("kept_text")), "n_chars": F.length("kept_text").cast("long")}, docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs.select("doc_id", "text"), tokenizer_path("word_bpe_49k.json"), end_id=1, keep_ids=True)


STAGES = [("language_id", language_id), ("exact_dedup", exact), ("near_dedup", near), ("substring_dedup", substrings), ("pack", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
