"""A training-corpus pipeline over ``documents``. Each stage works on all that the one before it kept."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import bpe, exact_dedup, mixing, simhash, toxicity
from lattica.llm.common import fresh, held, release, shared_dir, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Scratch tables of the stage that ran last.
_left: list[str] = []


def stage(body: Stage) -> Stage:
    """A stage of the pipeline. Each stage's result is written before the next one begins, so that one deletes its scratch tables."""

    @wraps(body)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark, _left)
        _left.clear()
        before = set(held())
        out = body(spark, docs, sf_dir)
        _left.extend(p for p in held() if p not in before)
        return out

    return run_stage


@stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model doesn't reject (score below 0.5), the model fitted on the table's own labels."""
    labels = table(spark, sf_dir, "labels").filter(~toxicity.held_out("doc_id"))
    model = toxicity.fit(docs, labels)
    (score,) = fresh(docs, "_score")
    return docs.withColumn(score, toxicity.score(docs, model)).filter(F.col(score) < 0.5).select(*docs.columns)


@stage
def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal but for white space."""
    return exact_dedup.keep_one(docs)


@stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more."""
    return simhash.drop_near_copies(docs)


@stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources at their target weights, in training order; documents repeat as the targets ask."""
    return mixing.apply_mix(docs)


@stage
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each document of the mix, and of the text decoded again."""
    return bpe.encode(docs, *bpe.default_vocabulary())


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("simhash near-dedup", drop_near_copies),
    ("mix sources", mix_sources),
    ("bpe", encode),
]

#: A fitted classifier and the encoder can't be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, step) in enumerate(STAGES):
        out = step(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        path = f"{shared_dir(spark)}/lattica-stage{i}-{uuid.uuid4().hex}"
        atexit.register(release, spark, [path])
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
