import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenscribe import api, cli
from lumenscribe.operators import frontend, jpeg, raster, render
from lumenscribe.sources import truetype
from lumenscribe.streaming import micro_batch, table_function

FONT = "/usr/share/fonts/truetype/dejavu/DejaVuSans.ttf"
needs_font = pytest.mark.skipif(not os.path.exists(FONT), reason="no such font here")


def drawn(text="TEST TEST", idx=3, face=None, **params):
    return render.sample(idx, text, face or render.GridFace(), render.Params(**{"extension": "png"} | params).checked(), 1)


@pytest.mark.parametrize("params", [
    {}, {"size": 64, "background_type": 1}, {"background_type": 2}, {"skewing_angle": 15}, {"skewing_angle": 9, "random_skew": True}, {"blur": 3}, {"blur": 3, "random_blur": True},
    *({"distorsion_type": d, "distorsion_orientation": o, "background_type": 1} for d in (1, 2, 4) for o in (0, 1, 2)), {"distorsion_type": 3}, {"width": 300, "alignment": 0}, {"width": 300, "alignment": 2},
    {"orientation": 1}, {"orientation": 1, "space_width": 2, "character_spacing": 3}, {"fit": True, "margins": (0, 0, 0, 0)}, {"stroke_width": 2, "stroke_fill": "red"}, {"text_color": "#000,#00f"},
    {"image_mode": "L"}, {"image_mode": "RGBA"}, {"image_mode": "1"}, {"character_spacing": 4},
])
def test_samples_have_their_size_and_are_the_same_again(params):
    row = drawn(**params)
    image = raster.unpng(row["image"])
    assert image.shape[:2] == (row["height"], row["width"])
    assert row["width" if params.get("orientation") else "height"] == params.get("size", 32)
    assert image.min() < 128 < image.max()
    assert drawn(**params) == row


@pytest.mark.parametrize("params", [{}, {"skewing_angle": 7}, {"distorsion_type": 1, "distorsion_orientation": 2}, {"distorsion_type": 3}])
def test_boxes_hold_the_masks_ink(params):
    row = drawn(size=96, output_mask=1, background_type=1, **params)
    found = raster.ink_extents(raster.unpng(row["mask"]))
    assert len(found) == len(row["char_positions"]) == 8
    for k, *ink in found:
        box = row["char_positions"][k - 1]["bbox"]
        assert all(a - 4 <= i for a, i in zip(box[:2], ink[:2])) and all(i <= a + 4 for a, i in zip(box[2:], ink[2:]))


@pytest.mark.parametrize("params", [{"orientation": 3}, {"is_handwritten": True}, {"is_handwritten": True, "orientation": 1}, {"extension": "gif"}, {"extension": "jpg", "image_mode": "RGBA"}, {"image_mode": "CMYK"}, {"distorsion_type": 3, "distorsion_orientation": 2}])
def test_what_cannot_be_is_told_before_any_work(params):
    with pytest.raises(ValueError):
        render.Params(**params).checked()
    assert render.Params().extension == "jpg"


def test_kernels():
    square = [np.array([(2, 2), (8, 2), (8, 8), (2, 8)], float)]
    assert raster.fill(square, 10, 10).sum() == 36
    hole = square + [np.array([(4, 4), (4, 6), (6, 6), (6, 4)], float)]
    assert raster.fill(hole, 10, 10).sum() == 32 and raster.fill([], 3, 3).sum() == 0
    image = np.arange(5 * 7 * 3, dtype=np.uint8).reshape(5, 7, 3)
    assert (raster.unpng(raster.png(image)) == image).all()
    assert raster.turn(image, 90, False).shape == (7, 5, 3) and (np.rot90(image) == raster.turn(image, 90, False)).all()
    flat = np.full((9, 9, 3), 77, np.uint8)
    assert (raster.blur(flat, 2) == 77).all() and (raster.resize(flat, 20, 4) == 77).all()
    noise = raster.gaussian_noise(200, 200, raster.draw(1, 2, "n"))
    assert abs(noise.mean() - 235) < 1 and abs(noise.std() - 9.8) < 0.6
    assert raster.picture(30, 40, image, raster.draw(1, 1, "p")).shape == (30, 40, 3)
    for k in (1, 254, 255, 600):
        mask = np.zeros((4, 4, 3), np.uint8)
        mask[1, 2] = raster.mask_color(k)
        assert raster.ink_extents(mask) == [(k, 2, 1, 2, 1)]
    ink = np.zeros((4, 4, 3), np.uint8)
    assert raster.too_alike(raster.rgba(flat[:4, :4]), ink, flat)
    ink[:] = 1
    assert not raster.too_alike(raster.rgba(flat[:4, :4] * 0), ink, raster.plain_white(4, 4))


def opened_by_the_jvm(spark, body):
    """Pixels [row, column, RGB] as another decoder reads them."""
    jvm = spark._jvm
    image = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(bytearray(body)))
    w, h = image.getWidth(), image.getHeight()
    if image.getRaster().getNumBands() == 1:  # its colours would be converted from linear grey
        grey = np.frombuffer(bytes(image.getRaster().getDataBuffer().getData()), np.uint8).reshape(h, w, 1)
        return np.repeat(grey, 3, axis=2).astype(int)
    values = np.array(list(image.getRGB(0, 0, w, h, None, 0, w)), np.int64).reshape(h, w)
    return np.stack([values >> 16 & 255, values >> 8 & 255, values & 255], axis=2)


@pytest.mark.parametrize("height,width", [(8, 8), (32, 101), (65, 7), (1, 1)])
def test_jpeg_is_read_by_another_decoder(spark, height, width):
    draw = np.random.default_rng(height)
    smooth = raster.resize(draw.integers(0, 256, (3, 3, 3), dtype=np.uint8), width, height)
    for image in (smooth, smooth[:, :, :1], draw.integers(0, 256, (height, width, 3), dtype=np.uint8)):
        for quality in (30, 75, 100):
            told = opened_by_the_jvm(spark, jpeg.encode(image, quality))
            assert told.shape == (height, width, 3)
            error = np.abs(told - np.broadcast_to(image, told.shape).astype(int))
            if quality == 100:
                assert error.max() <= 4
            elif image is smooth and quality == 75:
                assert error.mean() < 6
    with pytest.raises(ValueError):
        jpeg.encode(raster.rgba(smooth))


def test_samples_as_jpeg(spark):
    exact, lossy = drawn(size=64, background_type=1), drawn(size=64, background_type=1, extension="jpg")
    told = opened_by_the_jvm(spark, lossy["image"])
    assert lossy["file_name"].endswith(".jpg") and np.abs(told - raster.unpng(exact["image"])).mean() < 3
    grey = opened_by_the_jvm(spark, drawn(extension="jpeg", image_mode="L")["image"])
    assert grey.shape[0] == 32


def test_pictures_of_any_format_are_backgrounds(spark, tmp_path):
    red, green = (np.full((40, 300, 3), c, np.uint8) for c in ((200, 10, 10), (10, 200, 10)))
    (tmp_path / "a.jpg").write_bytes(jpeg.encode(red, 95))
    (tmp_path / "b.png").write_bytes(raster.png(green))
    (tmp_path / "c.txt").write_text("no picture")
    pictures = render.load_pictures(spark, str(tmp_path))
    assert [p.shape for p in pictures] == [(40, 300, 4)] * 2 and np.abs(pictures[0][:, :, :3].astype(int) - red).max() < 6 and (pictures[1][:, :, :3] == green).all()
    rows = spark.createDataFrame([(k, "text") for k in range(8)], "idx bigint, text string")
    out = render.rendered(rows, render.Params(background_type=3, image_dir=str(tmp_path), extension="png"), 1).collect()
    corners = {tuple(raster.unpng(bytes(r["image"]))[0, 0] > 100) for r in out}
    assert len(out) == 8 and corners == {(True, False, False), (False, True, False)}
    monkey, render.PICTURE_BYTES = render.PICTURE_BYTES, 10
    try:
        with pytest.raises(ValueError):
            render.load_pictures(spark, str(tmp_path))
    finally:
        render.PICTURE_BYTES = monkey


@needs_font
def test_truetype():
    font = truetype.opened(FONT)
    assert font.em == 2048 and font.names[font.cmap[ord("A")]] in ("A", "uni0041")
    box = truetype.bounds(font.contours(font.cmap[ord("H")]))
    assert 1400 < box[3] < 1600 and box[1] == 0
    assert font.parts(font.cmap[ord("é")]) and len(font.contours(font.cmap[ord("é")])) == 3
    assert truetype.text_width(font, "HH", 20) == round(2 * font.advances[font.cmap[ord("H")]] * 20 / 2048)
    left, top, right, bottom = truetype.text_box(font, "Hg", 20)
    assert left >= 0 and top < -10 and bottom > 0 and right > 20
    face = render.FontFace(FONT)
    row = drawn("Hello, Wörld", face=face, size=64, output_bboxes=1)
    assert len(row["char_positions"]) == 11 and row["boxes"]
    assert [role for role, _ in face.glyph('"')[3]] == ["UPPER_VOWEL"] and [role for role, _ in face.glyph("n")[3]] == ["BASE"]
    assert truetype.char_class({97, 98, 99, 233}) == r"\x{61}-\x{63}\x{e9}"


def test_iterators(spark):
    numbers = api.FromStrings(spark, ["TEST1", "TEST2"], count=3, output_mask=1)
    got = list(numbers)
    assert [label for _, label in got] == ["TEST1", "TEST2", "TEST1"] and got[0][0][0].shape[0] == 32
    with pytest.raises(StopIteration):
        numbers.next()
    image, label = next(api.FromRandom(spark, count=2, length=2, size=40))
    assert image.shape[0] == 40 and len(label.split()) == 2
    assert next(api.FromDict(spark, count=1, words=["ab", "cd"], length=3))[1].count(" ") == 2
    articles = spark.createDataFrame([("One two three. Four. Five six\nseven eight. ",)], "text string")
    assert [label for _, label in api.FromArticles(spark, articles, count=3, minimum_length=2)] == ["One two three", "Five six seven eight", "One two three"]
    assert next(api.FromStrings(spark, ["a b"], count=1, rtl=True))[1] == "a b"


def test_command_line(spark, tmp_path):
    source, out = tmp_path / "in.txt", tmp_path / "out"
    source.write_text("one line \n\nTHREE\nfour\n")
    cli.main([str(out), "-i", str(source), "-c", "3", "-na", "2", "-om", "1", "-obb", "1", "-oc", "-ca", "upper", "-b", "1", "-e", "png"], spark)
    names = sorted(os.listdir(out / "base/0000"))
    assert [n for n in names if n.endswith(".png") and "mask" not in n] == ["0.png", "2.png"]
    meta = json.loads((out / "base/0000/0_metadata.json").read_text())
    assert meta["text"] == "ONE LINE" and len(meta["char_bboxes"]) == 7
    train = json.loads((out / "coco-output/annotations/train.json").read_text())
    assert train["images"][0]["file_name"].startswith("base/0000/") and train["annotations"][0]["id"] == 1
    before = os.stat(out / "base/0000/0.png").st_mtime_ns
    cli.main([str(out), "-i", str(source), "-na", "2", "-b", "1", "-e", "png"], spark)
    assert os.path.exists(out / "base/0000/3.png") and os.stat(out / "base/0000/0.png").st_mtime_ns == before
    cli.main([str(tmp_path / "r"), *"-rs -num -c 4 -w 2".split()], spark)
    assert len([n for n in os.listdir(tmp_path / "r/base/0000") if n.endswith(".jpg")]) == 4
    with pytest.raises(SystemExit):
        cli.main([str(out), "-i", "/no/such/file"], spark)
    assert len(cli.FLAGS) + 1 == 44


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("alpha\nbeta\n")
    lines = micro_batch.text_lines(spark, str(tmp_path / "in"))
    for _ in range(2):
        query = micro_batch.render_stream(lines, render.Params(), 1, str(tmp_path / "out"), str(tmp_path / "cp"))
        query.awaitTermination(120)
    rows = spark.read.parquet(str(tmp_path / "out")).select("text", F.length("image").alias("n")).collect()
    assert sorted(r["text"] for r in rows) == ["alpha", "beta"] and all(r["n"] > 100 for r in rows)


def test_a_function_distorts(spark):
    plain = drawn(size=64, background_type=1, offset=lambda at: 0, offset_reach=3)
    bent = drawn(size=64, background_type=1, offset=lambda at: at % 7 - 3, offset_reach=3)
    assert plain["width"] and plain["image"] != bent["image"]
    rows = spark.createDataFrame([(3, "TEST TEST")], "idx bigint, text string")
    params = render.Params(size=64, background_type=1, extension="png", offset=lambda at: at % 7 - 3, offset_reach=3)
    assert bytes(render.rendered(rows, params, 1).first()["image"]) == bent["image"]


def test_table_function(spark):
    table_function.register(spark)
    rows = spark.sql("select * from draw_samples('TEST TEST', 3, 2, '{\"extension\": \"png\"}', 1)").collect()
    assert [r["idx"] for r in rows] == [3, 4] and bytes(rows[0]["image"]) == drawn()["image"]
    assert spark.sql("select * from draw_samples(null, 3, 2)").count() == 0


def test_fallback_fonts_are_drawn_from_a_folder(tmp_path):
    for name in ("b.ttf", "a.otf", "c.txt"):
        (tmp_path / name).write_text("")
    assert [os.path.basename(f) for f in render.latin_fonts(str(tmp_path))] == ["a.otf", "b.ttf"]
    assert render.latin_fonts("") == [] and render.latin_fonts("/some/font.ttf") == ["/some/font.ttf"]


def test_a_language_alone_draws_its_dictionary(spark, tmp_path):
    cli.main([str(tmp_path / "o"), *"-l de -c 3 -na 2 -b 1".split()], spark)
    assert sorted(os.listdir(tmp_path / "o/base/0000")) == ["0.jpg", "1.jpg", "2.jpg"]
    with pytest.raises(ValueError):
        cli.main([str(tmp_path / "o"), *"-l xx -c 3".split()], spark)


def test_a_glyph_is_drawn_once_and_requests_are_spread(spark, monkeypatch):
    drawn_shapes, fill, face = [], raster.fill, render.GridFace()
    monkeypatch.setattr(raster, "fill", lambda *a, **k: drawn_shapes.append(1) or fill(*a, **k))
    first = render.sample(3, "abcd abcd", face, render.Params(), 1)
    times = len(drawn_shapes)
    again = render.sample(3, "abcd abcd", face, render.Params(), 1)
    assert times <= 6 and len(drawn_shapes) == times and again == first
    one = frontend.spread(spark.range(1000).coalesce(1), "id", 100)
    assert one.rdd.getNumPartitions() == 10 and one.count() == 1000
    assert frontend.spread(spark.range(1000), "id", 1).rdd.getNumPartitions() == 100


def test_grey_is_coded_as_colours_are():
    grey = np.repeat(np.random.default_rng(5).integers(0, 256, (21, 30, 1), dtype=np.uint8), 3, axis=2)
    image = raster.blur(grey, 1)
    assert raster.distinct_planes(image)[0] == [0, 0, 0] and (image == np.concatenate([raster.blur(grey[:, :, c : c + 1], 1) for c in range(3)], axis=2)).all()
    turned = raster.turn(grey, 7, True)
    assert (turned == np.concatenate([raster.turn(grey[:, :, c : c + 1], 7, True) for c in range(3)], axis=2)).all()


def test_quasicrystals_are_the_sum_of_their_waves():
    for key, (height, width) in enumerate([(32, 120), (1, 9), (9, 1), (64, 33)]):
        rng = raster.draw(1, key, "q")
        frequency, phase, turns = rng.random() * 30 + 20, rng.random() * 2 * np.pi, int(rng.integers(10, 21))
        y, x = (np.linspace(-2 * np.pi, 2 * np.pi, n) if n > 1 else np.zeros(1) for n in (width, height))
        r, a = np.hypot(x[:, None], y[None, :]), np.arctan2(y[None, :], x[:, None])
        z = sum(np.cos(r * np.sin(a + k * np.pi * 2 / turns) * frequency + phase) for k in range(turns))
        assert (raster.quasicrystal(height, width, raster.draw(1, key, "q")) == (255 - np.rint(255 * z / turns)).clip(0, 255)).all()
