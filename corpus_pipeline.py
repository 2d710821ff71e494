"""A cleaning pipeline made of the training-data operators.

Toxic documents go, near copies but the first of each group go, passages that
repeat are cut, personal data are masked, and what stays is packed into sequences.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import minhash_odd, packing, pii, suffix_dedup, toxicity
from lodestrata.llm.common import condensed, documents, free, labels

#: Near-duplicate stages on word shingles take five words and this similarity.
SHINGLE, SIMILAR_PERCENT = 5, 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold; trained on all labelled rows.

    Null and empty texts have no similar word and stay; repeated rows go or stay together; rows with a null id are scored, not
    trained on; without toxic labels all stay; texts of any length are scored whole; an empty table stays empty.
    """
    machine = toxicity.fit(docs, labels(spark, sf_dir), F.lit(True))
    return toxicity.keep_clean(docs, machine)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest doc_id.

    Of rows that repeat a doc_id one stays, the one with the first text (null texts last). Null, empty and blank texts are copies of nothing and stay;
    rows with a null id are compared with nothing and stay, repeats included. Texts of any length are compared whole.
    """
    found = minhash_odd.near_duplicates(docs, SHINGLE, SIMILAR_PERCENT)
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("id")).distinct()
    repeated = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("id"))
    rows = docs.select("doc_id", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    rows = rows.join(gone, rows["doc_id"] == gone["id"], "left_anti")
    single = rows.join(repeated, rows["doc_id"] == repeated["id"], "left_anti").select("row")
    # a group is the rows of one doc_id; only those with repeats are grouped, and only one row is held
    order = F.struct(F.col("row.text").isNull().alias("none"), F.col("row.text").alias("text"))
    several = rows.join(repeated, rows["doc_id"] == repeated["id"], "left_semi").groupBy("doc_id").agg(F.min_by("row", order).alias("row"))
    return single.union(several.select("row")).select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that an earlier place has.

    Null and empty texts, rows with a null id and texts below the passage length stay as they are. Texts of any length are
    searched whole; a text that is cut away altogether stays as an empty one.
    """
    return suffix_dedup.without_repeats(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by their kind.

    Null and empty texts stay as they are; repeated rows and rows with a null id are masked each; texts of any length are
    masked whole; columns may have any names.
    """
    return pii.mask(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces with their places in sequences.

    A null or empty text is the end token alone; repeated rows and rows with a null id are packed each; long texts are cut into
    pieces; an empty table packs into an empty one.
    """
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("repeated_passages", cut_repeats),
    ("personal_data", mask_personal_data),
    ("packing", pack),
]

#: Model scores, suffix sorting and packing have no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again; what a stage read is deleted when it is done."""
    docs = documents(spark, sf_dir)
    for _, stage in STAGES:
        before, docs = docs, condensed(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir))
        free(before)
    return docs
