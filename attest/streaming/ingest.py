"""Evidence as it arrives: the batch expressions over file streams, with state that is bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import mrz


def files(spark: SparkSession, path: str, schema: str, per_trigger: int = 64) -> DataFrame:
    """Parquet files below a path, as they come. Every trigger takes a bounded number."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def parsed_zones(lines: DataFrame, name: str, year: int) -> DataFrame:
    """A stream of (doc_id, lines) parsed: stateless."""
    return lines.select("doc_id", mrz.parsed(mrz.normalised(F.col("lines")), name, year).alias("z")).where(F.col("z").isNotNull()).select("doc_id", "z.*")


def first_symbols(symbols: DataFrame, time: str = "ts", late: str = "10 minutes") -> DataFrame:
    """The first of equal symbols of a document; state for a symbol goes when the watermark passes it."""
    return symbols.withWatermark(time, late).dropDuplicatesWithinWatermark(["doc_id", "format", "text"])


def decision_counts(decisions: DataFrame, time: str = "ts", window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Decisions by window: what an operator of the service watches."""
    return decisions.withWatermark(time, late).groupBy(F.window(time, window), "decision").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "decision", "n")


def write(stream: DataFrame, path: str, checkpoint: str, once: bool = True):
    """To Parquet, exactly once; with `once` all that is there is taken and the query ends."""
    w = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (w.trigger(availableNow=True) if once else w).start()
