"""Drawing as a table function of SQL: select * from draw_samples('text', 7, 10, '{"size": 48}')."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from lumenscribe.operators import render

COLUMNS = "idx bigint, text string, file_name string, width int, height int, image binary"


class DrawSamples:
    """count samples of a text, numbered from start; params are those of render.Params as JSON; lateral joins draw a table's texts."""

    def eval(self, text: str, start: int, count: int, params: str = "{}", seed: int = 0) -> Iterator[tuple]:
        shared, face = render.Params(**json.loads(params)).checked(), render.GridFace()
        for idx in range(start, start + count) if text is not None else ():
            if row := render.sample(idx, text, face, shared, seed):
                yield tuple(row[name.split()[0]] for name in COLUMNS.split(", "))


def register(spark: SparkSession, name: str = "draw_samples") -> None:
    spark.udtf.register(name, udtf(DrawSamples, returnType=COLUMNS))
