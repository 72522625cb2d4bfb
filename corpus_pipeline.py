"""From raw documents to token ids, in five stages.

Each stage takes (spark, docs, sf_dir), works on all rows of `docs` and returns
the rows that stay, with the columns of documents; the last returns ids.

Documents are compared row by row: of equal rows one stays, rows of equal or null
doc_id stay or go by their own text. Null and empty texts are scored by the
classifier like others, have no lines or shingles, and encode to null and no ids.
Empty tables give empty results; further columns, whatever their names, stay as they
are up to the last stage. The order of stages is given: what near copies share with
their first place goes as repeated lines before they are compared, so of some a
remnant of other lines stays.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm.decontaminate import contained
from gleanery.llm.jaccard import jaccard_components
from gleanery.llm.lines import WORD, line_dedup
from gleanery.llm.quality import quality_filter
from gleanery.llm.queries import encoded_digest, table
from gleanery.llm.unigram import round_trip
from gleanery.plans.lineage import Scratch


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It learns from the labels that op2 learns from."""
    return quality_filter(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs of lines go, and documents that had words and have none left."""
    out = line_dedup(docs.select(F.struct(*docs.columns).alias("_of"), "doc_id", "text"))
    emptied = (F.col("n_removed") > 0) & ~F.col("text").rlike(WORD)
    changed = F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("_of.n_chars"))
    new = {"text": F.col("text"), "n_chars": changed}
    return out.where(~F.coalesce(emptied, F.lit(False))).select(*(new.get(c, F.col("_of")[c]).alias(c) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row stays, that with the smallest doc_id; rows without one come last."""
    # the texts are written once, not beside the row that holds them
    rows = Scratch(spark).write(docs.select(F.struct(*docs.columns).alias("_of"), F.monotonically_increasing_id().alias("_row")))
    found = jaccard_components(rows.select("_row", F.col("_of.text").alias("text")), "_row").where("n_shingles > 0").select(F.col("doc_id").alias("_row"), "component_id")
    named = found.join(rows.select("_row", F.col("_of.doc_id").alias("doc_id")), "_row")
    top = named.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "_row"))["_row"].alias("_top"), F.count("*").alias("n")).where("n > 1")
    gone = named.join(top, "component_id").where("_row != _top").select("_row")
    return rows.join(gone, "_row", "left_anti").select("_of.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain an item of the benchmark go."""
    keyed = docs.select(F.struct(*docs.columns).alias("_of"), "text", F.xxhash64("doc_id", "text").alias("_key"))
    gone = contained(keyed, table(spark, sf_dir, "benchmark"), "_key").select(F.col("doc_id").alias("_key")).distinct()
    return keyed.join(gone, "_key", "left_anti").select("_of.*")


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text, and whether they decode to it."""
    return encoded_digest(round_trip(docs), "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("encoding", encoding),
]

#: SQL can't express the classifier and the encoding; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written as Parquet and read again."""
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
