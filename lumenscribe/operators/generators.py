"""Request generators: strings, dictionary, random text, articles; and a pull interface."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenscribe.functions import strings
from lumenscribe.functions.draws import below, between
from lumenscribe.operators.frontend import cycled, lookup, numbered

#: The longest that a line of a strings file may be.
LINE_LENGTH = 200


def from_strings(requests: DataFrame, items: DataFrame, fonts: DataFrame | None = None) -> DataFrame:
    """Request idx (from 1) takes text and font in turn: (idx - 1) modulo their number."""
    at = requests.withColumn("__at", F.col("idx") - 1)
    out = cycled(at, items.select("pos", F.substring("text", 1, LINE_LENGTH).alias("text")), "text", "__at")
    return (out if fonts is None else cycled(out, fonts, "font", "__at")).drop("__at")


def from_dict(requests: DataFrame, words: DataFrame, seed: int, length: int = 1, variable: bool = False) -> DataFrame:
    """length words (or 1 .. length) drawn with replacement, joined by a space; words have pos and word."""
    n = words.count()
    if not n:
        raise ValueError("the dictionary is empty")
    k = between(seed, "length", F.col("idx"), 1, length).cast("int") if variable else F.lit(length)
    drawn = requests.select("*", F.explode(F.sequence(F.lit(1), k)).alias("__j"))
    drawn = drawn.withColumn("__pos", below(seed, F.concat(F.lit("word"), F.col("__j")), F.col("idx"), n))
    found = drawn.join(lookup(words.select(F.col("pos").alias("__pos"), "word")), "__pos")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__j", "word"))), lambda w: w["word"]), " ")
    return found.groupBy(*requests.columns).agg(text.alias("text"))


def from_random(requests: DataFrame, seed: int, length: int = 1, variable: bool = False, letters: bool = True, numbers: bool = True, symbols: bool = True, lang: str = "en") -> DataFrame:
    """Random words of an alphabet; no shuffle."""
    alphabet = strings.pool(letters, numbers, symbols, lang)
    return requests.withColumn("text", strings.random_text(seed, F.col("idx"), alphabet, length, variable, lang))


def from_articles(articles: DataFrame, minimum_length: int = 1, text: str = "text") -> DataFrame:
    """Sentences of more words than that, with their place in the article."""
    keep = [c for c in articles.columns if c != text]
    return articles.select(*keep, F.posexplode(strings.sentences(F.col(text), minimum_length)).alias("pos", "text"))


def requests(spark: SparkSession, count: int, start: int = 1) -> DataFrame:
    if count < 0:
        raise ValueError("a batch has an end: use streaming.requests for an endless one")
    return spark.range(start, start + count).withColumnRenamed("id", "idx")


def items(df: DataFrame, value: str, order: str, name: str = "text") -> DataFrame:
    """pos, name: values by a global order, ready to be cycled through or drawn from."""
    return numbered(df.select(F.col(order), F.col(value).alias(name)), order, name="pos").select("pos", name)


def pull(samples: DataFrame) -> Iterator:
    """Samples one by one, partition by partition, on the driver."""
    return samples.toLocalIterator(prefetchPartitions=True)
