"""Exact deduplication in DataFrame operations only.

Texts are equal when identical after each run of white space becomes one space. Digests place the rows, contents decide:
the whole normalised text is part of the key of every combining step, so texts that share a digest stay apart. Copies meet
in three steps, none of which gathers a whole group:

1. each task folds its own rows (the partial side of the aggregate);
2. rows of one digest and salt are merged (the copies of one text are spread over SALTS tasks);
3. the winners of the salts, at most SALTS for each task's text, are merged.

What comes out is narrow (digest, winner, size). It is written to the shared folder, so that the join that takes it back to
the rows has an exchange on either side, which adaptive execution splits where one text holds a large part of all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, free_name, written

#: Tasks over which the copies of one text are spread.
SALTS = 16
ADDED = ("keep_id", "group_size", "kept", "text_sha256")


def normalised(text: Column) -> Column:
    """Null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_CLASS + "+", " ")


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def classes(docs: DataFrame, salts: int = SALTS, place=digest) -> DataFrame:
    """One row for each distinct text: _digest, keep_id, group_size. place: the digest of a normalised text.

    Should two texts share a digest, the query fails with a message instead of merging them.
    """
    rows = docs.select("doc_id", normalised(F.col("text")).alias("_text")).withColumns({"_digest": place(F.col("_text")), "_salt": F.pmod(F.xxhash64("doc_id"), F.lit(salts))})
    merged = rows.groupBy("_digest", "_salt", "_text").agg(F.min("doc_id").alias("_least"), F.count("*").alias("_n"))
    winners = merged.groupBy("_digest", "_text").agg(F.min("_least").alias("_least"), F.sum("_n").alias("_n"))
    told = winners.groupBy("_digest").agg(F.min("_least").alias("keep_id"), F.sum("_n").alias("group_size"), F.count("*").alias("_texts"))
    alone = F.when(F.col("_texts") == 1, F.col("group_size")).otherwise(F.raise_error(F.lit("two different texts share a digest")).cast("long"))
    return told.select("_digest", "keep_id", alone.alias("group_size"))


def marked(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """docs with keep_id, group_size, kept and text_sha256; columns of docs with these names give way.

    One row for each row given. A null text is an empty one, empty texts form a group. keep_id is the least doc_id of the
    group, null where all are null. kept is doc_id = keep_id (nulls are equal here): a row repeated with its doc_id is kept as
    often as it comes, a row without doc_id goes unless its whole group has none. An empty table gives an empty table.
    """
    rows, key = docs.drop(*ADDED), free_name(docs, "_digest")
    found = written(classes(docs, salts), "copies").withColumnRenamed("_digest", key)
    rows = rows.withColumn(key, digest(normalised(F.col("text")))).join(found, key, "left")
    return rows.withColumns({"kept": F.col("doc_id").eqNullSafe(F.col("keep_id")), "text_sha256": F.lower(F.hex(key))}).drop(key)


def exact_dedup(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """The rows of docs that stay, with the columns of docs and their values, whatever the columns are called.

    Of equal texts the row with the least doc_id stays; a null text is an empty one, and empty texts are equal. A row that is
    repeated with that doc_id stays as often as it comes. Rows without a doc_id stay only if their whole group has none.
    An empty table gives an empty table.
    """
    key, keep = free_name(docs, "_digest"), free_name(docs, "_keep")
    found = written(classes(docs, salts).select(F.col("_digest").alias(key), F.col("keep_id").alias(keep)), "copies")
    rows = docs.withColumn(key, digest(normalised(F.col("text")))).join(found, key, "left")
    return rows.where(F.col("doc_id").eqNullSafe(F.col(keep))).select(*(F.col("`" + c.replace("`", "``") + "`") for c in docs.columns))
