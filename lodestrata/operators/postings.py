"""Text indexes: positions of tokens, and lookups in them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import Tokenizer, has_phrase, tokens


def occurrences(docs: DataFrame, key: str, text: str, tokenizer: Tokenizer = tokens) -> DataFrame:
    """(key, pos, token), one row per token."""
    return docs.select(key, F.posexplode(tokenizer(F.col(text))).alias("pos", "token"))


def positional_index(docs: DataFrame, key: str, text: str, tokenizer: Tokenizer = tokens) -> DataFrame:
    """(key, token, positions in order); a group is one token of one document."""
    return occurrences(docs, key, text, tokenizer).groupBy(key, "token").agg(F.sort_array(F.collect_list("pos")).alias("positions"))


def inverted_index(docs: DataFrame, key: str, text: str, tokenizer: Tokenizer = tokens) -> DataFrame:
    """(token, key, freq)."""
    return occurrences(docs, key, text, tokenizer).groupBy("token", key).agg(F.count("*").alias("freq"))


def search_texts(docs: DataFrame, text: str, phrase: list[str], tokenizer: Tokenizer = tokens) -> DataFrame:
    """Rows whose text holds the phrase, by a scan without any shuffle."""
    raw = F.col(text)
    hints = [raw.contains(t) for t in dict.fromkeys(phrase) if t] if tokenizer is tokens else []
    likely = docs.where(reduce(lambda a, b: a & b, hints)) if hints else docs
    return likely.where(has_phrase(tokenizer(raw), phrase))


def search_index(index: DataFrame, key: str, phrase: list[str]) -> DataFrame:
    """(key) of the documents with the phrase, from a positional index.

    Each token's positions less its place in the phrase must have one in common.
    """
    if not phrase:
        return index.select(key).limit(0)
    wanted = F.create_map(*(F.lit(x) for i, t in enumerate(phrase) for x in (f"{i}", t)))
    places = F.filter(F.transform(F.sequence(F.lit(0), F.lit(len(phrase) - 1)), lambda i: F.when(wanted[i.cast("string")] == F.col("token"), i)), lambda i: i.isNotNull())
    hits = index.where(F.col("token").isin(list(dict.fromkeys(phrase)))).withColumn("place", F.explode(places))
    bases = hits.select(key, "place", F.explode("positions").alias("pos")).select(key, "place", (F.col("pos") - F.col("place")).alias("base"))
    return bases.groupBy(key, "base").agg(F.countDistinct("place").alias("n")).where(F.col("n") == len(phrase)).select(key).distinct()


def members(values: DataFrame, token: str, index: DataFrame) -> DataFrame:
    """Rows of ``values`` whose token occurs anywhere in the index: the exact form of a Bloom filter."""
    known = index.select(F.col("token").alias("__known")).distinct()
    return values.join(known, values[token] == known["__known"], "left_semi")


def directory(docs: DataFrame, key: str, text: str, tokenizer: Tokenizer = tokens) -> DataFrame:
    """(key, n_tokens, n_distinct) of every document."""
    parts = tokenizer(F.col(text))
    return docs.select(key, F.size(parts).cast("bigint").alias("n_tokens"), F.size(F.array_distinct(parts)).cast("bigint").alias("n_distinct"))
