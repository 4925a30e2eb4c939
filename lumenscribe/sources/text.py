"""Text sources: dictionaries, string files, fonts' listings, sample metadata."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenscribe.functions import strings
from lumenscribe.operators.coco import METADATA
from lumenscribe.operators.frontend import numbered


def file_lines(spark: SparkSession, path: str) -> DataFrame:
    """pos, text: a file's lines in order, as a text reader splits them; a byte-order mark is dropped."""
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"))
    return numbered(rows, "f", "b", "i", name="pos").select("pos", F.col("value").alias("text"))


def dictionary(spark: SparkSession, path: str) -> DataFrame:
    """pos, word: entries of a dictionary file, split at every kind of line break, empty ones left out."""
    whole = spark.read.text(path).select(F.col("value"), F.monotonically_increasing_id().alias("i"))
    words = whole.select("i", F.posexplode(strings.lines(F.col("value"))).alias("j", "word")).where(F.char_length("word") > 0)
    return numbered(words, "i", "j", name="pos").select("pos", "word")


#: The dictionaries that come with the library, a file for each language.
DICTS = Path(__file__).resolve().parents[1] / "dicts"


def language_words(spark: SparkSession, lang: str, folder: str = "") -> DataFrame:
    """pos, word: the dictionary <lang>.txt of a folder, or of the library's own, which the driver reads: executors needn't have it."""
    if folder:
        return dictionary(spark, f"{folder.rstrip('/')}/{lang}.txt")
    path = DICTS / f"{lang}.txt"
    if not path.is_file():
        raise ValueError(f"no dictionary for {lang}: there are {', '.join(sorted(p.stem for p in DICTS.glob('*.txt')))}")
    words = [w for w in path.read_text(encoding="utf-8").splitlines() if w]
    return spark.createDataFrame(list(enumerate(words)), "pos bigint, word string")


def font_folder(spark: SparkSession, root: str, lang: str) -> str:
    """root/<lang>, or root/latin if there is none."""
    home = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{lang}")
    there = home.getFileSystem(spark._jsc.hadoopConfiguration()).exists(home)
    return f"{root.rstrip('/')}/{lang if there else 'latin'}"


def string_file(spark: SparkSession, path: str) -> DataFrame:
    """pos, text: lines that are not empty, of 200 characters at most; an empty file is an error."""
    lines = file_lines(spark, path).where(F.char_length("text") > 0)
    out = numbered(lines.select(F.col("pos").alias("p"), F.substring("text", 1, 200).alias("text")), "p", name="pos").select("pos", "text")
    if out.isEmpty():
        raise ValueError(f"no lines in {path}")
    return out


def fonts(spark: SparkSession, folder: str, only_ttf: bool = False) -> DataFrame:
    """pos, font: the files of a folder by path; contents are not read."""
    reader = spark.read.format("binaryFile")
    if only_ttf:
        reader = reader.option("pathGlobFilter", "*.ttf")
    return numbered(reader.load(folder).select(F.col("path").alias("font")), "font", name="pos").select("pos", "font")


def metadata(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame]:
    """Metadata documents one folder down, with their bucket; and the ones that can't be read."""
    raw = spark.read.option("pathGlobFilter", "*_metadata.json").text(f"{base}/*", wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    parsed = raw.select("path", "value", F.element_at(F.split("path", "/"), -2).alias("bucket"), F.from_json("value", METADATA).alias("m"))
    good = F.col("m.image_id").isNotNull() & F.col("m.file_name").isNotNull()
    return parsed.where(good).select("bucket", "m.*"), parsed.where(~F.coalesce(good, F.lit(False))).select("path", "value")
