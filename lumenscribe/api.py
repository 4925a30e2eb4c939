"""Pull interface: iterators of (image, label), or ((image, mask), label) with masks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenscribe.functions import arabic
from lumenscribe.operators import generators, raster, render
from lumenscribe.operators.frontend import cycled, numbered
from lumenscribe.sources import text as text_sources

#: How many samples an endless generator has drawn at a time.
ROUND = 1000


class _Samples:
    """An iterator over rounds of samples; count -1 never ends."""

    def __init__(self, spark: SparkSession, count: int = -1, fonts: list[str] | None = None, seed: int = 0, **params):
        self.spark, self.count, self.seed = spark, count, seed
        self.fonts = spark.createDataFrame(list(enumerate(fonts)), "pos bigint, font string") if fonts else None
        self.params = replace(render.Params(extension="png"), **params | {"extension": "png"}).checked()  # pixels are handed out as they are
        self.made, self._rows = 0, iter(())

    def texts(self, requests: DataFrame) -> DataFrame:
        """requests with text, and label if it differs."""
        raise NotImplementedError

    def samples(self, start: int, count: int) -> DataFrame:
        """The samples of requests start .. start + count - 1 as a DataFrame; the way for more than a few."""
        asked = self.texts(generators.requests(self.spark, count, start))
        if self.fonts is not None:
            asked = cycled(asked.withColumn("__at", F.col("idx") - 1), self.fonts, "font", "__at").drop("__at")
        label = "label" if "label" in asked.columns else "text"
        drawn = render.rendered(asked, self.params, self.seed).select("idx", "image", "mask")
        return asked.select("idx", F.col(label).alias("label")).join(drawn, "idx", "left").orderBy("idx")

    def __iter__(self) -> Iterator:
        return self

    def __next__(self):
        row = next(self._rows, None)
        if row is None:
            n = ROUND if self.count < 0 else min(ROUND, self.count - self.made)
            if n <= 0:
                raise StopIteration
            self._rows = generators.pull(self.samples(self.made + 1, n))
            self.made += n
            row = next(self._rows)
        image = None if row["image"] is None else raster.unpng(bytes(row["image"]))
        if self.params.output_mask and image is not None:
            return (image, raster.unpng(bytes(row["mask"]))), row["label"]
        return image, row["label"]

    next = __next__


class FromStrings(_Samples):
    """The strings in turn; rtl joins Arabic letters and puts them in visual order, the label is as given.

    reshape is a Column function for rtl text, if another way of shaping is wanted;
    language "ku" drops vowel marks.
    """

    def __init__(self, spark, strings: list[str], count: int = -1, rtl: bool = False, *, language: str = "ar", reshape=None, **more):
        super().__init__(spark, count, **more)
        if not strings:
            raise ValueError("no strings")
        self.items, self.rtl = spark.createDataFrame(list(enumerate(strings)), "pos bigint, text string"), rtl
        self.reshape = reshape or (lambda text: arabic.displayed(arabic.shaped(text, language == "ku")))

    def texts(self, requests):
        out = generators.from_strings(requests, self.items)
        if not self.rtl:
            return out
        return out.withColumn("label", F.col("text")).withColumn("text", self.reshape(F.col("text")))


class FromDict(_Samples):
    """Words of a dictionary file or list, or of the library's dictionary of a language, drawn with replacement."""

    def __init__(self, spark, count: int = -1, *, path: str = "", words: list[str] | None = None, language: str = "en", length: int = 1, allow_variable: bool = False, **more):
        super().__init__(spark, count, **more)
        self.words = spark.createDataFrame(list(enumerate(words)), "pos bigint, word string") if words else text_sources.dictionary(spark, path) if path else text_sources.language_words(spark, language)
        self.length, self.variable = length, allow_variable

    def texts(self, requests):
        return generators.from_dict(requests, self.words, self.seed, self.length, self.variable)


class FromRandom(_Samples):
    """Random text of letters, numbers, symbols."""

    def __init__(self, spark, count: int = -1, *, language: str = "en", length: int = 1, use_letters=True, use_numbers=True, use_symbols=True, allow_variable=False, **more):
        super().__init__(spark, count, **more)
        self.how = (length, allow_variable, use_letters, use_numbers, use_symbols, language)

    def texts(self, requests):
        return generators.from_random(requests, self.seed, *self.how)


class FromArticles(_Samples):
    """Sentences of a table of articles, in turn: without a network, articles are any DataFrame with a text."""

    def __init__(self, spark, articles: DataFrame, count: int = -1, minimum_length: int = 1, **more):
        super().__init__(spark, count, **more)
        sentences = generators.from_articles(articles.select(F.monotonically_increasing_id().alias("a"), "text"), minimum_length)
        self.items = numbered(sentences.withColumnRenamed("pos", "p"), "a", "p", name="pos").select("pos", "text")

    def texts(self, requests):
        return generators.from_strings(requests, self.items)
