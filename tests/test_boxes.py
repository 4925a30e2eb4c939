import json
import math
import random

import pytest
from pyspark.sql import functions as F

from lumenscribe.functions import geometry
from lumenscribe.operators import coco, frontend, masks, render
from lumenscribe.plans import layout_queries

PLAIN = "5 22 31 58,36 22 57 58,62 22 85 59,88 22 114 58,115 22 128 59,129 22 155 58,160 22 181 58,186 22 209 59,212 22 238 58"
EXTENTS = [(1, 6, 23, 30, 57), (2, 37, 23, 56, 57), (3, 63, 23, 84, 58), (4, 89, 23, 113, 57), (6, 130, 23, 154, 57), (7, 161, 23, 180, 57), (8, 187, 23, 208, 58), (9, 213, 23, 237, 57)]


def mask_boxes(spark, extents, tess=False):
    df = spark.createDataFrame([(extents,)], "e array<struct<k:int,minx:int,miny:int,maxx:int,maxy:int>>")
    return [tuple(b) for b in df.select(masks.boxes(F.col("e"), F.lit(400), F.lit(64), tess).alias("b")).first()["b"]]


def test_gap_boxes(spark):
    assert mask_boxes(spark, EXTENTS) == [tuple(map(int, b.split())) for b in PLAIN.split(",")]
    tess = mask_boxes(spark, EXTENTS, True)
    assert tess[0] == (5, 6, 31, 42) and tess[4] == (115, 5, 128, 43)
    assert mask_boxes(spark, EXTENTS[1:]) == [] == mask_boxes(spark, [])
    assert len(mask_boxes(spark, [EXTENTS[0], (4, 89, 23, 113, 57)])) == 1
    shuffled = random.Random(1).sample(EXTENTS, len(EXTENTS))
    assert mask_boxes(spark, shuffled) == mask_boxes(spark, EXTENTS)
    for tess in (False, True):
        assert [tuple(b) for b in render.mask_boxes(EXTENTS, 400, 64, tess)] == mask_boxes(spark, EXTENTS, tess)


def test_turning_keeps_the_middle_and_holds_the_box(spark):
    df = spark.createDataFrame([(10.0, 5.0, 30.0, 15.0)], "x1 double, y1 double, x2 double, y2 double")
    b = geometry.box(*(F.col(k) for k in geometry.SIDES))
    for angle in (0, 30, 90, -45):
        got = df.select(geometry.rotate_box(b, angle, F.lit(100), F.lit(40)).alias("b")).first()["b"]
        c, s = abs(math.cos(math.radians(angle))), abs(math.sin(math.radians(angle)))
        assert got["x2"] - got["x1"] == pytest.approx(20 * c + 10 * s)
        assert got["y2"] - got["y1"] == pytest.approx(20 * s + 10 * c)
    same = df.select(geometry.wave_box(b, "sin", False, False, F.lit(100), F.lit(40)).alias("b")).first()["b"]
    assert tuple(same) == (10, 5, 30, 15)


def test_scaling_truncates_towards_zero(spark):
    df = spark.createDataFrame([(-3, -1, 3, 5)], "x1 int, y1 int, x2 int, y2 int")
    got = df.select(geometry.scale_box(geometry.box(*(F.col(k) for k in geometry.SIDES)), F.lit(0.5)).alias("b")).first()["b"]
    assert tuple(got) == (-1, 0, 1, 2)
    with pytest.raises(ValueError):
        geometry.resize(F.lit(1), F.lit(1), 32, (5, 5, 5, 5), 3)


def metadata(spark, n):
    draw = random.Random(3)
    rows = []
    for k in range(n):
        boxes = [[x, 2, x + draw.randrange(3), 9] for x in range(0, draw.randrange(5) * 4, 4)]
        rows.append((k, f"{k // 10:04d}", f"{k}.png", 50, 10, "t", [{"glyph_name": "a", "bbox": b, "base_bbox": b} for b in boxes], boxes))
    return spark.createDataFrame(rows, f"image_id bigint, bucket string, file_name string, width int, height int, text string, char_positions {coco.METADATA.split('char_positions ')[1].rsplit(', text_offset', 1)[0]}, char_bboxes array<array<int>>")


def test_coco_ids_are_dense_and_splits_exact(spark, tmp_path):
    rows = metadata(spark, 57)
    split = coco.split(rows, 5, 0.8)
    assert split.where("split = 'train'").count() == int(57 * 0.8)
    kept = coco.with_annotations(split)
    anns = coco.annotations(kept).orderBy("id").collect()
    assert [a["id"] for a in anns] == list(range(1, len(anns) + 1))
    assert [a["split"] for a in anns] == sorted(a["split"] for a in anns)
    source = {r["image_id"]: r["char_bboxes"] for r in rows.collect()}
    assert {a["image_id"] for a in anns} == {k for k, b in source.items() if b} == {r["id"] for r in coco.images(kept).collect()}
    for k, boxes in source.items():
        mine = [a for a in anns if a["image_id"] == k]
        if boxes:
            assert mine[0]["category_id"] == 1 and mine[0]["bbox"][0] == min(b[0] for b in boxes)
            assert len(mine) - 1 == sum(b[2] > b[0] and b[3] > b[1] for b in boxes)
    coco.save(coco.images(kept), coco.annotations(kept), str(tmp_path / "out"), "2020-01-02 03:04:05")
    both = [json.loads((tmp_path / "out/annotations" / f"{s}.json").read_text()) for s in ("train", "val")]
    assert sum(len(d["annotations"]) for d in both) == len(anns) and both[0]["info"]["year"] == 2020
    assert [a["id"] for a in both[0]["annotations"]] == list(range(1, len(both[0]["annotations"]) + 1))


def test_boxes_of_many_lists_at_once(spark):
    """Lists of all kinds in a batch, null extents and null lists too, as the renderer boxes each; a tab in a name is a gap."""
    draw = random.Random(4)
    lists = [[(k, k * 9, draw.randrange(60), k * 9 + 7, draw.randrange(64)) for k in range(1, 12) if draw.random() < 0.8] for _ in range(200)]
    rows = [(i, None if i == 7 else [None] * (i % 5 == 0) + e) for i, e in enumerate(lists)]
    df = spark.createDataFrame(rows, "i int, e array<struct<k:int,minx:int,miny:int,maxx:int,maxy:int>>").coalesce(1)
    for tess in (False, True):
        got = dict(df.select("i", masks.boxes(F.col("e"), F.lit(90), F.lit(64), tess)).collect())
        assert got[7] is None
        assert all([tuple(b) for b in got[i]] == [tuple(b) for b in render.mask_boxes(e, 90, 64, tess)] for i, e in enumerate(lists) if i != 7)


def test_names_with_tabs(spark, tmp_path):
    spark.createDataFrame([(1, "a\tb"), (2, "a b")], "p_partkey bigint, p_name string").write.parquet(str(tmp_path / "part.parquet"))
    rows = [tuple(r)[1:] for r in layout_queries.QUERIES["mask_gap_boxes"](spark, str(tmp_path)).orderBy("p_partkey", "k").collect()]
    assert len(rows) == 6 and rows[:3] == rows[3:]


def test_only_keys_and_names_are_shuffled_into_splits(spark, monkeypatch):
    seen, split, cut = [], coco.split, frontend.cut
    monkeypatch.setattr(coco, "split", lambda df, *a, **k: seen.append(df.columns) or split(df, *a, **k))
    monkeypatch.setattr(frontend, "cut", lambda df: seen.append("cut") or cut(df))
    images = layout_queries.QUERIES["coco_images"](spark, "/root/testdata/sf0.001")
    annotations = layout_queries.QUERIES["coco_annotations"](spark, "/root/testdata/sf0.001")
    assert seen == [["p_partkey", "text"], "cut"] * 2
    assert "polygon" not in images._jdf.queryExecution().optimizedPlan().toString() and annotations.count() > images.count() > 0


def test_backgrounds_are_spread_over_tasks(spark, tmp_path):
    spark.range(4100).withColumnRenamed("id", "c_custkey").coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    assert layout_queries.QUERIES["background_noise"](spark, str(tmp_path)).rdd.getNumPartitions() == 3
