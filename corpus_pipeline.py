"""A corpus pipeline of four llm operators: each stage works on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import language, packing, queries, simhash, toxicity
from foliant.llm.common import Scratch, table

#: A document is toxic from this score on; a language is rejected under this one, or if the second-best
#: has more than this share of its probability.
TOXIC, SURE, ALIKE = 0.5, 0.5, 0.8
#: Chunks that a worker remembers in packing, fewer than by itself, as the stages before fill its memory too.
REMEMBERED = 500_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is under TOXIC; a null text is scored as the empty one."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.with_toxicity(docs, model).where(F.col("toxicity") < TOXIC).select(docs.columns)


def drop_unidentified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that was told; texts without a letter go, and those that no language
    has half the probability of, or of which two languages are nearly as likely, however many are learnt."""
    named = language.with_language(docs, language.fit(docs), close=ALIKE)
    told = (F.col("lang_pred") != language.UNDETERMINED) & ~F.col("lang_ambiguous") & (F.col("lang_score") >= SURE)
    return named.where(told).select(docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that SimHash links, the one with the smallest id."""
    return simhash.drop_near_duplicates(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens of what is left."""
    return packing.pack(docs, queries.public_tokenizers.path("byte_bpe_50k.json"), remembered=REMEMBERED)


STAGES = [
    ("toxicity", drop_toxic),
    ("language", drop_unidentified),
    ("simhash", drop_copies),
    ("packing", pack),
]

#: SQL cannot express the learnt stages; the tests hold run() against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each one's result written and read again; what is read no more is deleted."""
    scratch = Scratch(spark, "pipeline")
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with scratch.inside():
            docs = scratch.write(stage(spark, docs, sf_dir), name)
        if before is not None:
            scratch.drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
