"""A training-corpus pipeline over `documents`.

STAGES are (name, function) pairs; a function takes (spark, docs, sf_dir) and returns a
DataFrame, which is written as Parquet and read again as the next one's docs. So a stage
begins by deleting the intermediate tables of the one before. All but the last keep the
columns of documents. Sources below the largest are repeated up to `MOST_REPEATS` times by
the mixture, so a doc_id can stand in more than one row after it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from foliary.llm import exact_dedup, jaccard_rtree, langid, mixing, packing
from foliary.llm.scratch import Scratch, collecting, tune

MOST_REPEATS = 1.25
#: Words and chunks that a task of the first and the last stage keeps: fewer than by themselves, as workers go on
#: from stage to stage.
WORDS, CHUNKS = 300_000, 400_000
#: Intermediate tables of the stage that ran last, by application and input, if another stage follows it.
_before: dict[tuple[str, str], list[Scratch]] = {}


def stage(operator: Callable[[DataFrame], DataFrame], last: bool = False) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        tune(spark)
        run = (spark.sparkContext.applicationId, sf_dir)
        for scratch in _before.pop(run, []):
            scratch.close()
        with collecting() as own:
            out = operator(docs)
        if not last:
            _before[run] = own
        return out

    run_stage.__doc__ = operator.__doc__
    return run_stage


@stage
def known_language(docs: DataFrame) -> DataFrame:
    """Documents without a language that can be told go."""
    return langid.keep_known(docs, remembered=WORDS)


@stage
def exact_copies(docs: DataFrame) -> DataFrame:
    """Of equal texts the longest original stays."""
    return exact_dedup.drop_copies(docs)


@stage
def near_copies(docs: DataFrame) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, similarity of 0.8 or more."""
    return jaccard_rtree.drop_near_copies(docs)


@stage
def mixed_sources(docs: DataFrame) -> DataFrame:
    """Every document at least once, those of small sources up to the repetition limit."""
    return mixing.mix(docs, max_repeats=MOST_REPEATS)


def packed(docs: DataFrame) -> DataFrame:
    """Pieces of all rows in sequences of 1024 tokens."""
    return packing.pack(docs, remembered=CHUNKS)


STAGES = [
    ("language_id", known_language),
    ("exact_dedup", exact_copies),
    ("ngram_jaccard", near_copies),
    ("mixing", mixed_sources),
    ("packing", stage(packed, last=True)),
]
#: Language ID and packing can't be said in SQL; tests compare the pipeline with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, one) in enumerate(STAGES):
        docs = one(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = scratch.save(docs, name)
            if k:
                scratch.drop(STAGES[k - 1][0])
    return docs
