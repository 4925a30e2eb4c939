"""What the renderer computes in its kernels is what the Column expressions say, step by step and as a whole."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenscribe.functions import geometry, naming
from lumenscribe.functions.draws import between, plain_between, plain_u32, u32
from lumenscribe.operators import layout, raster, render

SEED, TEXTS = 5, ["TEST TEST", "a.b,c", "Wavy lines of text", "x", "one  two"]


def boxes_of(spark, rows):
    return spark.createDataFrame(rows, "k bigint, w bigint, h bigint, x1 double, y1 double, x2 double, y2 double").select("k", "w", "h", geometry.box(*(F.col(c) for c in geometry.SIDES)).alias("b"))


@pytest.fixture(scope="module")
def rows():
    draw = np.random.default_rng(2)
    out = []
    for k in range(60):
        w, h = int(draw.integers(30, 500)), int(draw.integers(8, 90))
        x, y = np.sort(draw.integers(0, w + 1, 2)), np.sort(draw.integers(0, h + 1, 2))
        out.append((k, w, h, float(x[0]), float(y[0]), float(x[1]), float(y[1])))
    return out


def collected(df, b):
    return {r["k"]: tuple(r["b"]) for r in df.select("k", b.alias("b")).collect()}


def test_draws_agree(spark):
    df = spark.range(50).select("id", u32(SEED, "t", F.col("id")).alias("u"), between(SEED, "t", F.col("id"), -3, 9).alias("b"), naming.pick_color(SEED, F.col("id"), "#102030,#a0b0c0", "fill").alias("c"))
    for r in df.collect():
        assert r["u"] == plain_u32(SEED, "t", r["id"]) and r["b"] == plain_between(SEED, "t", r["id"], -3, 9)
        assert tuple(r["c"]) == tuple(plain_between(SEED, f"fill-{c}", r["id"], a, b) for c, a, b in zip("rgb", (16, 32, 48), (160, 176, 192)))


@pytest.mark.parametrize("kind", ["sin", "cos", "jitter"])
@pytest.mark.parametrize("vertical,horizontal", [(True, False), (False, True), (True, True)])
def test_waves_agree(spark, rows, kind, vertical, horizontal):
    got = collected(boxes_of(spark, rows), geometry.wave_box(F.col("b"), kind, vertical, horizontal, F.col("w"), F.col("h"), SEED, F.col("k"), False))
    for k, w, h, *b in rows:
        reach = raster.reach_of(kind, h)
        down = raster.offsets(kind, w, reach, SEED, k, "down") if vertical else None
        right = raster.offsets(kind, h + 2 * reach if vertical else h, reach, SEED, k, "right") if horizontal else None
        if down is None:  # of rows alone there are no more than the canvas has
            right = np.append(right, raster.offsets(kind, h + 2 * reach, reach, SEED, k, "right")[h:])
        assert tuple(raster.wave_boxes(np.array([b]), reach, down, right)[0]) == got[k]


def test_boxes_follow_jittered_pixels():
    """A box around one pixel is around that pixel afterwards."""
    for k in range(30):
        image = np.zeros((20, 40, 3), np.uint8)
        y, x = k % 20, k * 7 % 40
        image[y, x] = 255
        reach = raster.reach_of("jitter", 20)
        down, right = raster.offsets("jitter", 40, reach, SEED, k, "down"), raster.offsets("jitter", 20 + 2 * reach, reach, SEED, k, "right")
        moved = raster.wave(image, reach, down, right)
        at = np.argwhere(moved.any(axis=2))
        box = raster.wave_boxes(np.array([[x, y, x, y]], float), reach, down, right)[0]
        assert len(at) == 1 and tuple(box) == (at[0][1], at[0][0], at[0][1], at[0][0])
        assert (down != right[:40][: len(down)]).any() if len(right) >= 40 else True


@pytest.mark.parametrize("angle", [0, 15, -30, 90])
def test_turning_agrees(spark, rows, angle):
    got = collected(boxes_of(spark, rows), geometry.rotate_box(F.col("b"), angle, F.col("w"), F.col("h")))
    for k, w, h, *b in rows:
        assert raster.turn_boxes(np.array([b]), angle, w, h)[0] == pytest.approx(got[k], abs=1e-6)


def test_curves_agree(spark, rows):
    amplitude = between(SEED, "curve", F.col("k"), 5, 20)
    got = collected(boxes_of(spark, rows), geometry.curve_box(F.col("b"), amplitude, F.col("w")))
    for k, w, _, *b in rows:
        assert tuple(raster.curve_boxes(np.array([b]), plain_between(SEED, "curve", k, 5, 20), w)[0]) == got[k]


@pytest.mark.parametrize("params", [
    {"output_bboxes": 1}, {"character_spacing": 3, "size": 64, "margins": (1, 2, 3, 4), "name_format": 1}, {"width": 700, "alignment": 2, "space_width": 0}, {"skewing_angle": 12, "name_format": 2}, {"skewing_angle": 20, "random_skew": True},
    {"distorsion_type": 3}, {"distorsion_type": 1, "distorsion_orientation": 2}, {"distorsion_type": 4, "distorsion_orientation": 2}, {"distorsion_type": 2, "distorsion_orientation": 1},
])
def test_samples_agree_with_columns(spark, params):
    """Layout, turning, distortion, scaling, alignment, names of whole samples, recomputed by expressions alone."""
    p = render.Params(**{"background_type": 1, "extension": "png"} | params).checked()
    texts = list(enumerate(TEXTS))[2:3] if p.random_skew else list(enumerate(TEXTS))
    angle = plain_between(SEED, "skew", 2, -p.skewing_angle, p.skewing_angle) if p.random_skew else p.skewing_angle
    scale = p.size / render.GridFace.em

    def metrics(codes):
        advance, drawn, *sides = layout.grid_metrics(codes)
        return advance * scale, drawn, *(v * scale for v in sides)

    df = layout.laid_out(spark.createDataFrame(texts, "k bigint, text string").coalesce(1), "text", p.size, p.character_spacing, metrics)
    df = df.select("k", "text", F.col("layout.width").alias("w"), F.col("layout.height").alias("h"), F.posexplode("layout.glyphs").alias("n", "g")).withColumn("b", F.col("g.box"))
    w, h, b = F.col("w"), F.col("h"), F.col("b")

    def step(box, width, height):
        return df.select("k", "text", "n", box.alias("b"), width.alias("w"), height.alias("h"))

    df = step(geometry.rotate_box(b, angle, w, h), *(geometry.rotated_size(w, h, angle) if angle else (w, h)))
    if p.distorsion_type == 3:
        amplitude = between(SEED, "curve", F.col("k"), 5, 20)
        df = step(geometry.curve_box(b, amplitude, w), w, h + amplitude)
    elif p.distorsion_type:
        kind, down, right = {1: "sin", 2: "cos"}.get(p.distorsion_type, "jitter"), p.distorsion_orientation != 1, p.distorsion_orientation != 0
        reach = geometry.wave_reach(kind, h)
        df = step(geometry.wave_box(b, kind, down, right, w, h, SEED, F.col("k"), False), w + 2 * reach if right else w, h + 2 * reach if down else h)
    sizes = geometry.resize(w, h, p.size, p.margins, 0, p.width)
    x = geometry.align(p.alignment, sizes["canvas_width"], sizes["text_width"], p.margins, p.width)
    moved = geometry.move_box(geometry.scale_box(b, sizes["ratio"]), x, F.lit(p.margins[0]))
    df = step(moved, sizes["canvas_width"], sizes["canvas_height"])
    name = F.concat(naming.safe_name(naming.sample_name(F.col("text"), F.col("k"), p.name_format, p.space_width)), F.lit(".png"))
    told = {}
    for r in df.select("k", "n", "b", w.cast("int").alias("w"), h.cast("int").alias("h"), name.alias("name"), naming.bucket(F.col("k")).alias("bucket")).collect():
        told.setdefault((r["k"], r["w"], r["h"], r["name"], r["bucket"]), {})[r["n"]] = [int(v) for v in r["b"]]
    drawn = {}
    for k, text in texts:
        s = render.sample(k, text, render.GridFace(), p, SEED)
        drawn[k, s["width"], s["height"], s["file_name"], s["bucket"]] = {n: c["bbox"] for n, c in enumerate(s["char_positions"])}
    assert drawn.keys() == told.keys()
    for key in drawn:
        # doubles of different order may fall on either side of a whole number
        assert all(abs(a - b) <= (1 if p.skewing_angle else 0) for n in drawn[key] for a, b in zip(drawn[key][n], told[key][n])), key


def test_tone_lift_agrees(spark):
    face = render.GridFace()
    for text in ("ก่", "กำ่", "กิ่ง", "ที่นี่", "ปู่", "abc"):
        items, x = [], 0.0
        for c in text:
            for one in (render.NIKHAHIT, render.SARA_AA) if c == render.SARA_AM else (c,):
                _, _, _, parts = face.glyph(one)
                roles = {r for r, _ in parts}
                b = [tuple(v * 32 / face.em for v in box) for _, box in parts]
                items.append((0.0, min((q[1] for q in b), default=None), max((q[3] for q in b), default=None), bool(roles & {"BASE", "LEADING_VOWEL", "LOWER_VOWEL"}), bool(roles & {"NIKHAHIT", "UPPER_VOWEL", "UPPER_DIACRITIC"}), "TONE" in roles))
        df = spark.createDataFrame([(items,)], "i array<struct<y:double,bottom:double,top:double,base:boolean,upper:boolean,tone:boolean>>")
        told = df.select(layout.tone_lift(F.col("i"), 32).alias("y")).first()["y"]
        assert render.lifts(text, face, 32) == pytest.approx(told)
