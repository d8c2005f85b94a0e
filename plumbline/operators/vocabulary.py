"""A vocabulary table matched against texts as a join: word n-grams of the texts meet the phrases by equality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import text as texts


def _grams(n: int) -> Column:
    """The n-grams of ``_tokens``, each by direct access to its words."""
    tokens = F.col("_tokens")
    if n == 1:
        return tokens
    words = lambda x, i: F.concat_ws(" ", x, *[F.get(tokens, i + j) for j in range(1, n)])
    return F.slice(F.transform(tokens, words), 1, F.greatest(F.size(tokens) - (n - 1), F.lit(0)))


def matches(docs: DataFrame, id_col: str, text_col: str, vocabulary: DataFrame) -> DataFrame:
    """(id, name, rank): names of the vocabulary whose key stands in a text as whole words, each once, with its least rank. [STR12, STR17, JOI17]

    vocabulary has key, name and rank: lower ranks come first, so hints get lower ones than names. Keys and texts are compared
    by ``functions.text.latin_key``; a key without a letter or digit matches nothing. Each text gives its distinct n-grams of
    the lengths that keys have, so a join by equality does what testing each key against each text would, and no list is
    held in the plan. A vocabulary that Spark knows to be small is broadcast by it, any other shuffled, and a phrase that
    very many texts hold is a key whose rows adaptive execution can split, as both sides are plain shuffles.
    """
    phrases = vocabulary.select(texts.latin_key(F.col("key")).alias("_gram"), "name", "rank").where("_gram <> ''")
    phrases = phrases.withColumn("_n", F.size(F.split("_gram", " ")))
    lengths = sorted(r[0] for r in phrases.select("_n").distinct().collect())  # a few small numbers
    tokens = F.filter(F.split(texts.latin_key(F.col(text_col)), " "), lambda x: x != "")
    rows = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("_id"), tokens.alias("_tokens"))
    grams = F.array_distinct(F.concat(*[_grams(n) for n in lengths])) if lengths else F.array().cast("array<string>")
    # Outer: else the grams are made again, to test that there are any.
    found = rows.select("_id", F.explode_outer(grams).alias("_gram")).where("_gram IS NOT NULL").join(phrases.drop("_n"), "_gram")
    return found.groupBy(F.col("_id").alias(id_col), "name").agg(F.min("rank").alias("rank"))


def match_lists(docs: DataFrame, id_col: str, text_col: str, vocabulary: DataFrame, out: str = "names") -> DataFrame:
    """The rows, each with the list of its names in order of rank, then name; a text without any has an empty list. [STR12, JOI17]"""
    found = matches(docs, id_col, text_col, vocabulary)
    lists = found.groupBy(id_col).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "name"))), lambda x: x["name"]).alias(out))
    return docs.join(lists, id_col, "left").withColumn(out, F.coalesce(out, F.array().cast("array<string>")))
