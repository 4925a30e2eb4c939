"""Command line: draw samples of a file, a dictionary, random text or articles; optionally COCO files."""

from __future__ import annotations

import argparse
import json
import os
import sys
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenscribe.functions import arabic, strings
from lumenscribe.functions.naming import parse_margins
from lumenscribe.operators import coco, frontend, generators, render
from lumenscribe.sources import text as text_sources

# short, long, kind (a type, or None for a switch), default; what it does
FLAGS = [
    ("i", "input_file", str, "", "a text in each line"), ("l", "language", str, "en", "language of text, dictionary and fonts"),
    ("c", "count", int, 0, "samples at most; 0 for all lines, or 1000 without a file"), ("rs", "random_sequences", None, False, "random text"),
    ("let", "include_letters", None, False, "letters in random text"), ("num", "include_numbers", None, False, "digits in random text"), ("sym", "include_symbols", None, False, "symbols in random text"),
    ("w", "length", int, 1, "words a text"), ("r", "random", None, False, "1 to length words"), ("f", "format", int, 32, "height, or width if vertical"),
    ("t", "thread_count", int, 1, "local cores"), ("e", "extension", str, "jpg", "image format: jpg or png"), ("k", "skew_angle", int, 0, "degrees"), ("rk", "random_skew", None, False, "up to that angle either way"),
    ("wk", "use_wikipedia", None, False, "sentences of the articles in the input file"), ("bl", "blur", int, 0, "blur radius"), ("rbl", "random_blur", None, False, "up to that radius"),
    ("b", "background", int, 0, "0 noise, 1 white, 2 quasicrystal, 3 pictures"), ("hw", "handwritten", None, False, "not available"), ("na", "name_format", int, 0, "0 text_number, 1 number_text, 2 number"),
    ("om", "output_mask", int, 0, "1: masks too"), ("obb", "output_bboxes", int, 0, "1: boxes, 2: in Tesseract's form"), ("oc", "output_coco", None, False, "metadata and COCO files"),
    ("d", "distorsion", int, 0, "0 none, 1 sine, 2 cosine, 3 curve, 4 random"), ("do", "distorsion_orientation", int, 0, "0 vertical, 1 horizontal, 2 both; a curve's height"),
    ("wd", "width", int, -1, "width; -1 for the text's"), ("al", "alignment", int, 1, "0 left, 1 centre, 2 right"), ("or", "orientation", int, 0, "0 horizontal, 1 vertical"),
    ("tc", "text_color", str, "#282828", "a colour, or two"), ("sw", "space_width", float, 1.0, "width of a space"), ("cs", "character_spacing", int, 0, "pixels between characters"),
    ("m", "margins", parse_margins, (5, 5, 5, 5), "one, or top,left,bottom,right"), ("fi", "fit", None, False, "crop to the ink"), ("ft", "font", str, "", "a font file"), ("fd", "font_dir", str, "", "a folder of .ttf files"),
    ("id", "image_dir", str, "", "pictures for backgrounds"), ("ca", "case", str, None, "upper or lower"), ("dt", "dict", str, "", "a dictionary file"), ("ws", "word_split", None, False, "split on words"),
    ("stw", "stroke_width", int, 0, "width of the stroke"), ("stf", "stroke_fill", str, "#282828", "colour of the stroke, or two"), ("im", "image_mode", str, "RGB", "RGB, RGBA, L or 1"), ("tr", "train_ratio", float, 0.8, "share of the training split"),
]
RENAMED = {"size": "format", "skewing_angle": "skew_angle", "background_type": "background", "distorsion_type": "distorsion", "is_handwritten": "handwritten"}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="lumenscribe", description=__doc__)
    out.add_argument("output_dir", nargs="?", default="out")
    for short, name, kind, default, about in FLAGS:
        how = {"action": "store_true"} if kind is None else {"type": kind, "default": default}
        out.add_argument(f"-{short}", f"--{name}", help=about, **how)
    out.add_argument("--seed", type=int, default=0, help="of all draws")
    out.add_argument("--latin_font", default="", help="a font for what the chosen one lacks, or a folder to draw one from")
    out.add_argument("--dict_dir", default="", help="a folder of <language>.txt, instead of the library's own")
    out.add_argument("--font_root", default="", help="a folder of font folders <language> and latin")
    return out


def texts(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """idx (from 0) and text."""
    n = a.count or 1000
    if a.random_sequences:
        return generators.from_random(generators.requests(spark, n, 0), a.seed, a.length, a.random, a.include_letters, a.include_numbers, a.include_symbols, a.language)
    if a.input_file and a.use_wikipedia:
        found = generators.from_articles(text_sources.file_lines(spark, a.input_file).withColumnRenamed("pos", "article"), a.length)
        out = frontend.numbered(found, "article", "pos").select("idx", "text")
    elif a.input_file:
        out = text_sources.file_lines(spark, a.input_file).select(F.col("pos").alias("idx"), strings.strip(F.col("text")).alias("text"))
    else:
        found = text_sources.dictionary(spark, a.dict) if a.dict else text_sources.language_words(spark, a.language, a.dict_dir)
        words = frontend.distinct_first(found, "word", "pos")
        out = frontend.numbered(words, "pos").select("idx", F.col("word").alias("text"))
    return out.where(F.col("idx") < a.count) if a.count else out


def params(a: argparse.Namespace) -> render.Params:
    given = vars(a)
    return render.Params(**{k: given[RENAMED.get(k, k)] for k in render.PARAMS if RENAMED.get(k, k) in given}).checked()


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    for path in filter(None, (a.input_file, a.dict, a.font)):
        if not os.path.isfile(path):
            raise SystemExit(f"cannot open {path}")
    shared = params(a)
    spark = spark or SparkSession.builder.master(f"local[{a.thread_count}]").appName("lumenscribe").getOrCreate()
    base = os.path.join(a.output_dir, "base")
    os.makedirs(base, exist_ok=True)
    asked = texts(spark, a)
    asked = asked.withColumn("text", strings.change_case(arabic.by_word(F.col("text")) if a.language == "ar" else F.col("text"), a.case))
    folder = a.font_dir or (text_sources.font_folder(spark, a.font_root, a.language) if a.font_root and not a.font else "")
    fonts = text_sources.fonts(spark, folder, True) if folder else spark.createDataFrame([(0, a.font)], "pos bigint, font string") if a.font else None
    if fonts is not None:
        asked = frontend.routed(asked, fonts, a.seed).withColumn("font", F.regexp_replace("font", "^file:/+", "/"))
    # what is there already is not drawn again; only names that are numbers can be told beforehand
    done = [(b, f) for b in sorted(os.listdir(base)) if os.path.isdir(os.path.join(base, b)) for f in os.listdir(os.path.join(base, b)) if f.endswith(f".{shared.extension}")]
    if done and a.name_format == 2:
        from lumenscribe.functions.naming import bucket

        named = asked.withColumn("bucket", bucket(F.col("idx"))).withColumn("file_name", F.concat(F.col("idx").cast("string"), F.lit(f".{shared.extension}")))
        asked = frontend.not_done(named, spark.createDataFrame(done, "bucket string, file_name string"))
    samples = render.rendered(asked, shared, a.seed)
    manifest = render.write_files(samples, os.path.abspath(base), shared)
    manifest.write.mode("append").parquet(os.path.join(a.output_dir, "manifest"))
    if a.output_coco:
        convert(spark, base, os.path.join(a.output_dir, "coco-output"), a.train_ratio, a.seed)
    return 0


def convert(spark: SparkSession, base: str, out: str, train_ratio: float = 0.8, seed: int = 0) -> None:
    """COCO files of the metadata under base; documents that can't be read are listed and left out."""
    if not any(f.endswith("_metadata.json") for _, _, files in os.walk(base) for f in files):
        print(f"no metadata under {base}")
        return
    good, bad = text_sources.metadata(spark, os.path.abspath(base))
    for row in bad.limit(20).collect():
        print(f"cannot read {row['path']}", file=sys.stderr)
    annotated = coco.with_annotations(coco.split(good, seed, train_ratio))
    coco.save(coco.images(annotated), coco.annotations(annotated), os.path.abspath(out), datetime.now(UTC).replace(tzinfo=None).isoformat(" ", "seconds"))
    print(json.dumps({"coco": out}))


if __name__ == "__main__":
    sys.exit(main())
