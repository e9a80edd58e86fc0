"""Image bytes: uploads, base64, decoding into pixels. A bad row carries an error code; it never fails a job."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

MOST_BYTES = 20 * 1024 * 1024
SUFFIXES = (".jpg", ".jpeg", ".png", ".heic", ".heif")
STATUS = {"empty_file": 400, "invalid_request": 400, "invalid_image": 400, "file_too_large": 413, "unsupported_media_type": 415, "validation_failed": 422, "model_unavailable": 503, "request_failed": 500}


def suffix(filename: Column) -> Column:
    """In lower case with its dot; .jpg for a name without one."""
    found = F.lower(F.regexp_extract(F.coalesce(filename, F.lit("")), r"[^/\\.][^/\\]*?(\.[^./\\]+)$", 1))
    return F.when(found == "", ".jpg").otherwise(found)


def upload_error(content: Column, filename: Column, most_bytes: int = MOST_BYTES) -> Column:
    size = F.coalesce(F.octet_length(content), F.lit(0))
    return F.when(size == 0, "empty_file").when(size > most_bytes, "file_too_large").when(~suffix(filename).isin(*SUFFIXES), "unsupported_media_type")


def http_status(error: Column) -> Column:
    """200 without an error; an unknown error is a failed request."""
    return F.when(error.isNull(), 200).otherwise(F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for p in STATUS.items() for x in p)), error), F.lit(500)))


def error_code(status: Column) -> Column:
    """The code of an error response by its status; a status without a code of its own is a failed request."""
    known = {400: "invalid_request", 413: "payload_too_large", 415: "unsupported_media_type", 422: "unprocessable_image", 503: "service_unavailable"}
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for p in known.items() for x in p)), status), F.lit("request_failed"))


def decoded_base64(value: Column) -> Column:
    """Strict base64, plain or as a data URL; null for anything else."""
    plain = F.regexp_replace(F.trim(value), "^data:[^,]*,", "")
    strict = plain.rlike("^[A-Za-z0-9+/\\s]*={0,2}$")
    return F.when(strict, F.try_to_binary(plain, F.lit("base64")))


def binary_files(spark: SparkSession, path: str) -> DataFrame:
    """path, content, error for files below a path, decoding nothing."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return raw.select("path", "content", upload_error(F.col("content"), F.col("path")).alias("error"))


@F.pandas_udf(BinaryType())
def _red_first(data: pd.Series, channels: pd.Series) -> pd.Series:
    """Bytes of pixels whose first three channels are turned around; gray ones as they are."""
    turn = lambda d, n: np.frombuffer(d, np.uint8).reshape(-1, n)[:, [2, 1, 0, *range(3, n)]].tobytes() if n >= 3 else bytes(d)
    return pd.Series([None if d is None else turn(d, int(n)) for d, n in zip(data, channels, strict=True)], dtype=object)


def pixels(spark: SparkSession, path: str) -> DataFrame:
    """path, height, width, channels, data (rows of red-green-blue bytes, as operators.imaging takes them) by Spark's image source, which gives blue first; files that are no image have height -1 and no data."""
    raw = spark.read.format("image").option("dropInvalid", "false").load(path).select(F.col("image.origin").alias("path"), "image.height", "image.width", F.col("image.nChannels").alias("channels"), "image.data")
    return raw.withColumn("data", F.when(F.col("height") > 0, _red_first("data", "channels")))


def upright_pixels(spark: SparkSession, path: str) -> DataFrame:
    """pixels() of files below a path, turned as their EXIF orientation says. Files are read whole for their headers, and their bytes go no further."""
    from ..operators import imaging

    tags = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("_file"), imaging.metadata("content")["orientation"].alias("_turn"))

    def turned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k, r in pdf[(pdf["_turn"] > 1) & pdf["data"].notna()].iterrows():
                image = imaging.upright(imaging.as_image(r["height"], r["width"], r["data"]), int(r["_turn"]))
                pdf.at[k, "height"], pdf.at[k, "width"], pdf.at[k, "data"] = image.shape[0], image.shape[1], image.tobytes()
            yield pdf.drop(columns="_turn")

    plain = lambda c: F.regexp_replace(c, "^[a-z]+:/+", "/")  # noqa: E731  (the two sources write schemes differently)
    rows = pixels(spark, path).alias("p")
    met = rows.join(tags, plain(F.col("path")) == plain(F.col("_file")), "left").select("path", "height", "width", "channels", "data", F.coalesce("_turn", F.lit(1)).alias("_turn"))
    return met.mapInPandas(turned, "path string, height int, width int, channels int, data binary")
