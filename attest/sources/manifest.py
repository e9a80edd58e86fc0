"""Asset manifests: path, size and SHA-256 of the files of a bundle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def files(spark: SparkSession, folder: str) -> DataFrame:
    """path (relative, with slashes) and content of all files below a folder."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    root = folder.rstrip("/") + "/"
    return raw.select(F.substring_index("path", root, -1).alias("path"), "content")


def described(rows: DataFrame) -> DataFrame:
    """From path, content: path, size, sha256."""
    return rows.select("path", F.octet_length("content").cast("long").alias("size"), F.sha2("content", 256).alias("sha256"))


def mismatches(noted: DataFrame, now: DataFrame) -> DataFrame:
    """Noted files that are missing, or have another size or digest. Files that were not noted are left alone."""
    found = now.select(F.col("path").alias("_p"), F.col("size").alias("_s"), F.col("sha256").alias("_h"))
    problem = F.when(F.col("_p").isNull(), "missing").when(F.col("size") != F.col("_s"), "size").when(F.col("sha256") != F.col("_h"), "sha256")
    return noted.join(found, F.col("path") == F.col("_p"), "left").withColumn("problem", problem).where(F.col("problem").isNotNull()).select("path", "size", "sha256", "problem")


def first_mismatch(noted: DataFrame, now: DataFrame) -> str | None:
    row = mismatches(noted, now).agg(F.min(F.struct("path", "problem")).alias("m")).first()["m"]
    return f"{row['path']}: {row['problem']}" if row else None
