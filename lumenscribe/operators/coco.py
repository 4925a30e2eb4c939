"""From sample metadata to COCO images and annotations."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenscribe.functions.draws import u32
from lumenscribe.functions.glyphs import FIELDS
from lumenscribe.operators.frontend import numbered
from lumenscribe.session import run_dir

CATEGORIES = [dict(id=k, name=n) for k, n in enumerate(("word", "character"), 1)]
_POSITION = "glyph_name string, grapheme string, is_upper_vowel boolean, is_lower_vowel boolean, bbox array<int>, " + ", ".join(f"{f}_bbox array<int>" for f in FIELDS)
METADATA = f"image_id bigint, file_name string, width int, height int, text string, char_bboxes array<array<int>>, char_positions array<struct<{_POSITION.replace(' ', ':').replace(',:', ', ')}>>, text_offset array<int>"


def component_boxes(positions: Column) -> Column:
    """All parts' boxes of the character positions, in the order of the fields."""
    each = F.transform(positions, lambda p: F.array(*(p[f"{f}_bbox"] for f in FIELDS)))
    return F.filter(F.flatten(each), lambda b: b.isNotNull() & (F.size(b) > 0))


def rectangle(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Clockwise from the top left."""
    return F.array(x1, y1, x2, y1, x2, y2, x1, y2)


def word_polygon(boxes: Column) -> Column:
    """The rectangle around all boxes; empty for none."""
    side = lambda k, of: of(F.transform(boxes, lambda b: F.get(b, F.lit(k))))
    hull = rectangle(side(0, F.array_min), side(1, F.array_min), side(2, F.array_max), side(3, F.array_max))
    return F.when(F.size(boxes) > 0, hull).otherwise(F.slice(hull, 1, 0))


def _annotation(category: int, polygon: Column, order: Column) -> Column:
    w, h = F.get(polygon, F.lit(2)) - F.get(polygon, F.lit(0)), F.get(polygon, F.lit(5)) - F.get(polygon, F.lit(1))
    box = F.array(F.get(polygon, F.lit(0)), F.get(polygon, F.lit(1)), w, h)
    return F.struct(order.alias("ord"), F.lit(category).alias("category_id"), polygon.alias("polygon"), box.alias("bbox"), (w.cast("bigint") * h).alias("area"))


def _has_area(b: Column) -> Column:
    return (F.get(b, F.lit(2)) > F.get(b, F.lit(0))) & (F.get(b, F.lit(3)) > F.get(b, F.lit(1)))


def annotations_of(boxes: Column, parts: Column) -> Column:
    """The word's annotation, then one for each part with an area; in order, inside the row."""
    # the polygon is a lambda's variable: it is computed once, not for each of its uses
    word = F.when(F.size(boxes) > 0, F.transform(F.array(word_polygon(boxes)), lambda p: _annotation(1, p, F.lit(0))))
    drawn = F.filter(parts, _has_area)
    rect = lambda b: rectangle(*(F.get(b, F.lit(k)) for k in range(4)))
    each = F.transform(drawn, lambda b, k: _annotation(2, rect(b), k + 1))
    return F.concat(F.coalesce(word, F.slice(each, 1, 0)), each)


def split(metadata: DataFrame, seed: int, train_ratio: float = 0.8, key: str = "image_id") -> DataFrame:
    """ord (a shuffled order from 0) and split; train has exactly int(n * ratio) rows."""
    shuffled = numbered(metadata.withColumn("__draw", u32(seed, "split", F.col(key))), "__draw", key, name="ord").drop("__draw")
    n = int(shuffled.count() * train_ratio)
    return shuffled.withColumn("split", F.when(F.col("ord") < n, "train").otherwise("val"))


def with_annotations(metadata: DataFrame, base: str = "base") -> DataFrame:
    """Metadata (with bucket) and their annotations; rows that have none are left out."""
    boxes, parts = F.col("char_bboxes"), component_boxes(F.col("char_positions"))
    drawn = F.coalesce(F.size(F.filter(parts, _has_area)), F.lit(0))
    word = F.when(F.size(boxes) > 0, 1).otherwise(0)
    path = F.concat_ws("/", F.lit(base), "bucket", "file_name")
    # counted apart, so that a query of images or counts builds no annotations
    out = metadata.withColumn("file_name", path).withColumn("n_anns", F.when(parts.isNull(), 0).otherwise(word + drawn)).where("n_anns > 0")
    return out.withColumn("anns", annotations_of(boxes, parts))


def images(annotated: DataFrame) -> DataFrame:
    return annotated.select("split", "ord", F.col("image_id").alias("id"), "file_name", "width", "height")


def annotations(annotated: DataFrame) -> DataFrame:
    """Annotations with dense ids from 1, train before val, words before their parts.

    Images are summed up in blocks of their order; the ids of an image's annotations
    follow from its first. The sums of blocks read the counts only.
    """
    rows = annotated.select("split", "ord", "image_id", "anns", F.col("n_anns").alias("n"), F.floor(F.col("ord") / 4096).alias("__block"))
    # the ids before an image: the sums of whole blocks before its own, and of the rows before it there
    within = F.sum("n").over(Window.partitionBy("__block").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1))
    placed = rows.withColumn("__in", F.coalesce(within, F.lit(0)))
    sums = rows.groupBy("__block").agg(F.sum("n").alias("s"))
    before = F.coalesce(F.sum("s").over(Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sums.select(F.col("__block").alias("__b"), before.alias("__before"))
    listed = placed.join(F.broadcast(starts), F.col("__block") == F.col("__b")).select("split", "image_id", (F.col("__before") + F.col("__in")).alias("start"), F.posexplode("anns").alias("k", "a"))  # one row a block
    return listed.select("split", (F.col("start") + F.col("k") + 1).alias("id"), "image_id", "a.category_id", F.array("a.polygon").alias("segmentation"), "a.bbox", "a.area", F.lit(0).alias("iscrowd"))


def json_parts(images: DataFrame, annotations: DataFrame, split_name: str, date: str, description: str = "Text detection dataset") -> Iterator[str]:
    """One split's COCO document piece by piece: rows stream through the driver, none are gathered."""
    head = dict(info=dict(year=int(date[:4]), date_created=date, version="1.0", description=description), categories=CATEGORIES, licenses=[])
    yield json.dumps(head, ensure_ascii=False)[:-1]
    for name, rows, order in (("images", images, "ord"), ("annotations", annotations, "id")):
        mine = rows.where(F.col("split") == split_name).orderBy(order).drop("split", "ord")
        yield f', "{name}": ['
        for k, row in enumerate(mine.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).toLocalIterator()):
            yield ("" if not k else ", ") + row["j"]
        yield "]"
    yield "}"


def save(images: DataFrame, annotations: DataFrame, out: str, date: str) -> None:
    """Parquet tables, the canonical form, beside train.json and val.json."""
    from pyarrow import fs as pafs

    spark = images.sparkSession
    home = run_dir(spark, "coco")
    images.write.parquet(f"{home}/images")
    annotations.write.parquet(f"{home}/annotations")
    images, annotations = spark.read.parquet(f"{home}/images"), spark.read.parquet(f"{home}/annotations")
    images.write.mode("overwrite").parquet(f"{out}/images")
    annotations.write.mode("overwrite").parquet(f"{out}/annotations_table")
    where, place = (pafs.LocalFileSystem(), out) if "://" not in out else pafs.FileSystem.from_uri(out)
    where.create_dir(f"{place}/annotations", recursive=True)
    for name in ("train", "val"):
        with where.open_output_stream(f"{place}/annotations/{name}.json") as file:
            for part in json_parts(images, annotations, name, date):
                file.write(part.encode())
