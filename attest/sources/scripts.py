"""The registry of line recognisers: which model reads a locale, and the characters of its classes.

    root/metadata/ocr_scripts.json    {"TextRecognizer": [{"netName": "...1049", "lcids": [1049, 1058]}, ..]}
    root/models/ocr/1049.onnx
    root/charsets/ocr/1049.txt        a code point a line, in the order of the classes
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors
from .catalogs import _there, numbered_lines

DEFINITIONS = "TextRecognizer array<struct<netName:string,lcids:array<int>>>"


def charset(spark: SparkSession, path: str) -> DataFrame:
    """file, characters: of text files with a code point in each line, in order; blank lines are left out. A line that is no code point fails the query."""
    lines = numbered_lines(spark, path).where(F.trim("value") != "")
    code = F.trim("value").try_cast("int")
    bad = F.concat(F.lit("no code point in "), F.col("file"), F.lit(": "), F.col("value"))
    lines = lines.select("file", "line", F.when(code.between(0, 0x10FFFF), F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise(F.raise_error(bad)).alias("c"))
    return lines.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("line", "c"))).alias("all")).select("file", F.col("all.c").alias("characters"))


def recognisers(spark: SparkSession, root: str) -> DataFrame:
    """model (a number), name, locales, place, characters: the definitions whose name ends in a number and whose model and charset are there. No metadata is an empty registry."""
    shape = "model int, name string, locales array<int>, place int, characters array<string>"
    folder = root.rstrip("/")
    if not all(_there(spark, f"{folder}/{x}") for x in ("metadata/ocr_scripts.json", "models/ocr", "charsets/ocr")):
        return spark.createDataFrame([], shape)
    text = spark.read.text(f"{folder}/metadata/ocr_scripts.json", wholetext=True)
    stated = text.select(F.posexplode(F.from_json("value", DEFINITIONS)["TextRecognizer"]).alias("place", "d"))
    stated = stated.select(F.regexp_extract("d.netName", "([0-9]+)$", 1).try_cast("int").alias("model"), F.col("d.netName").alias("name"), F.coalesce("d.lcids", F.array().cast("array<int>")).alias("locales"), "place").where(F.col("model").isNotNull())
    number = lambda c, kind: F.regexp_extract(c, rf"([0-9]+)\.{kind}", 1).try_cast("int")
    models = spark.read.format("binaryFile").load(f"{folder}/models/ocr").select(number("path", "onnx").alias("model")).distinct()
    charsets = charset(spark, f"{folder}/charsets/ocr").select(number("file", "txt").alias("model"), "characters")
    return stated.join(models, "model", "left_semi").join(charsets, "model")


def locale_models(registry: DataFrame) -> DataFrame:
    """locale, model, characters: of definitions that name one locale the last."""
    each = registry.select(F.explode("locales").alias("locale"), "place", "model", "characters")
    return each.groupBy("locale").agg(F.max_by(F.struct("model", "characters"), "place").alias("m")).select("locale", "m.model", "m.characters")


def read_lines(rows: DataFrame, registry: DataFrame, general: list[str]) -> DataFrame:
    """rows (with locale and steps: an array of scores of classes for each step) and model, text, confidence, read with the charset of the locale's model; model 0, of the charset `general`, where no model names the locale."""
    known = locale_models(registry).withColumnsRenamed({"locale": "_locale", "characters": "_characters"})
    met = rows.join(known, F.col("locale") == F.col("_locale"), "left")
    charsets = F.coalesce("_characters", F.array(*map(F.lit, general)))
    told = F.explode(F.array(vectors.ctc_decode(F.col("steps"), charsets))).alias("_t")
    return met.select(*rows.columns, F.coalesce("model", F.lit(0)).alias("model"), told).select(*rows.columns, "model", "_t.text", "_t.confidence")
