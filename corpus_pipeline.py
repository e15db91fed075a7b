"""From raw documents to packed sequences: each stage works on all that the one before has kept.

Every stage handles nulls in any column, empty and very long texts, ties, repeated rows, empty tables and further columns, which
it passes on untouched. A stage's result is to be written before the next stage is called. Every row is decided on for itself, with an id, without one, or with one that other rows have too.
"""

from __future__ import annotations

import uuid
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartlens.llm import langid, orderhash, pii, quality
from cartlens.llm.queries import packed, quality_field
from cartlens.llm.storage import drop, kept, recorded, sweep
from cartlens.session import delete


# Folders that stages have written for themselves and that their result may read until it is written.
_left: list[str] = []


def _stage(work):
    """A stage that first deletes what the stages before have left: their results are written by then."""

    @wraps(work)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        while _left:
            delete(spark, _left.pop())
        sweep(spark)
        with recorded() as made:
            found = work(spark, docs, sf_dir)
        _left.extend(made)
        return found

    return run


def _columns(docs: DataFrame) -> list[Column]:
    """All columns, whatever their names."""
    return [F.col(f"`{c}`") for c in docs.columns]


def _named(docs: DataFrame) -> tuple[DataFrame, str]:
    """The documents with an id of their own in a further column, whose name is returned: their own one if no other row has it, else a
    number above all ids. Only rows that share an id, or have none, are written once to number them."""
    name = f"id_{uuid.uuid4().hex}"
    ids = docs.select(F.col("doc_id").cast("bigint").alias("doc_id")).where("doc_id is not null")
    shared = kept(ids.groupBy("doc_id").count().where("count > 1").select("doc_id"), "shared")
    own = docs.withColumn(name, F.col("doc_id").cast("bigint"))
    here = own[name] == shared["doc_id"]
    once = own.where(F.col(name).isNotNull()).join(shared, here, "left_anti")
    others = own.join(shared, here, "left_semi").unionByName(own.where(F.col(name).isNull()))
    above = (ids.agg(F.max("doc_id")).first()[0] or 0) + 1
    others = kept(others.withColumn(name, F.monotonically_increasing_id() + F.lit(above)), "others")
    return once.unionByName(others), name


def _without(named: DataFrame, name: str, docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Documents whose own id is not among `ids`. The list of ids is written first, so the planner knows its size."""
    gone = kept(ids.toDF("gone"), "ids")
    return named.join(gone, named[name] == gone["gone"], "left_anti").select(_columns(docs))


@_stage
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages of the table; those like none of them, and those without letters, go."""
    languages, model = langid.fit(docs, "doc_id", "text", "lang")
    named, name = _named(docs)
    found = langid.identify(named, name, "text", languages, model, host=F.col("source"))
    return _without(named, name, docs, found.where("rejected").select("id"))


@_stage
def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose lines the field marks as good; all of them where labels of both kinds are missing."""
    field = quality_field(spark, sf_dir, docs)
    if field.weights is None:
        return docs
    return docs.where(quality.score("text", field) >= quality.GOOD_AT)


@_stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class: that with the smallest id."""
    named, name = _named(docs)
    found = orderhash.classes(named, name, "text")
    left = _without(named, name, docs, found.where("not kept").select("doc_id"))
    drop(found)
    return left


@_stage
def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a mark in place of each span of personal data."""
    found = pii.spans(docs, "text", docs.columns).select("carried.text", "carried", "spans")
    changed = found.select("carried", pii.redacted("text", "spans").alias("text"))
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("bigint")}
    return changed.select(*[new.get(c, F.col(f"carried.`{c}`")).alias(c) for c in docs.columns])


@_stage
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the sequences that the documents fill."""
    return packed(docs)


STAGES = [
    ("language_id", language_id),
    ("quality", quality_classifier),
    ("near_dedup", near_dedup),
    ("pii", personal_data),
    ("packing", packing),
]

# Models and tokens are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`; what each one returns is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        docs = kept(stage(spark, docs, sf_dir), name)
        if before is not None:
            drop(before)
        before = docs
    return docs
