"""Vector codes: each part of a vector is told by its nearest entry of that part's codebook, in integers throughout.

Codebooks come from Lloyd's rounds over all vectors, kept up by differences: the table of vectors holds the assignment of the round
before, and a round adds to running integer sums what parts whose assignment changed bring to their new entry and take from their old
one. Nothing else is shuffled, and that as one partial sum a task, entry and component. Integers make the result independent of
partitioning, retries and the order of sums.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from .common import forget, free_name, tidy, written

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Components become floor(SCALE * x). Beyond +-2^24, an |x| of 65,536, they stay at that, so that sums and distances are exact.
SCALE, MOST = 256, 1 << 24
#: Vectors compared at a time, and labels that may each hold a thousandth of the rows or more.
A_BATCH, HOT = 2048, 1000


def integers(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Which vectors of a list column are neither null nor hold null or non-finite components, and those as lists of integers."""
    sizes = pc.list_value_length(column).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    held = np.maximum(sizes, 0)
    ends = np.cumsum(held)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    good = (sizes >= 0) & (bad[ends] == bad[ends - held])
    told = np.clip(values[np.repeat(good, held)], -MOST, MOST)
    told = np.clip(np.floor(told * SCALE), -MOST, MOST).astype(np.int32)
    offsets = np.concatenate([[0], np.cumsum(held[good])]).astype(np.int32)
    return good, pa.ListArray.from_arrays(pa.array(offsets), pa.array(told))


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vectors, parts, width) and (parts, entries, width) -> the nearest entry of each part, ties to the lower one, and the squared distance to it."""
    most = max(np.abs(x).max(initial=0), np.abs(entries).max(initial=0))
    kind = np.float64 if x.shape[2] * (2 * int(most)) ** 2 < 1 << 53 else np.int64  # exact either way
    x, entries = x.astype(kind), entries.astype(kind)
    away = (entries * entries).sum(2)[:, None, :] - 2 * (x.transpose(1, 0, 2) @ entries.transpose(0, 2, 1))
    code = away.argmin(2)
    least = np.take_along_axis(away, code[:, :, None], 2)[:, :, 0].T + (x * x).sum(2)
    return code.T.astype(np.uint8), least.astype(np.int64)


@dataclass
class Codebooks:
    """Entries, and the running sums and counts that they come from: parts x entries x width, a size that rows do not change."""

    entries: np.ndarray
    sums: np.ndarray
    counts: np.ndarray

    @classmethod
    def of(cls, first: list[list[int]], parts: int) -> Codebooks:
        table = np.array(first, np.int64).reshape(len(first), parts, -1).transpose(1, 0, 2)
        return cls(table, np.zeros_like(table), np.zeros(table.shape[:2], np.int64))

    def add(self, changes: list) -> None:
        """Rows of (part, entry, place, change): a place beyond the components is the count. Entries become floors of means; those without parts stay."""
        width = self.entries.shape[2]
        for part, entry, place, change in changes:
            if place < width:
                self.sums[part, entry, place] += change
            else:
                self.counts[part, entry] += change
        used = self.counts > 0
        self.entries = np.where(used[:, :, None], self.sums // np.maximum(self.counts, 1)[:, :, None], self.entries)

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, A_BATCH):
            yield b.slice(at, A_BATCH)


def _matrix(column: pa.Array, shape: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """The rows whose list has as many components as the shape, and their lists."""
    rows = np.flatnonzero(pc.list_value_length(column).fill_null(-1).to_numpy(zero_copy_only=False) == shape[0] * shape[1])
    return rows, column.take(pa.array(rows)).flatten().to_numpy().astype(np.int64).reshape(len(rows), *shape)


def _bytes(codes: np.ndarray, rows: np.ndarray, count: int) -> pa.Array:
    out = [None] * count
    for k, code in zip(rows.tolist(), codes, strict=True):
        out[k] = code.tobytes()
    return pa.array(out, pa.binary())


def assigned(state: DataFrame, books: Codebooks) -> DataFrame:
    """state (vec_id, label, x, code) with the codes that the codebooks give now, the ones before as `earlier`, and the squared distance as `error`."""
    held = state.sparkSession.sparkContext.broadcast(books.entries)
    columns = state.select("vec_id", "label", "x", "code")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = held.value
        for b in _blocks(batches):
            rows, x = _matrix(b.column(2), (entries.shape[0], entries.shape[2]))
            codes, away = nearest(x, entries)
            error = np.zeros(b.num_rows, np.int64)
            error[rows] = away.sum(1)
            told = np.zeros(b.num_rows, bool)
            told[rows] = True
            yield pa.RecordBatch.from_arrays([*b.columns, _bytes(codes, rows, b.num_rows), pa.array(error, mask=~told)], names=["vec_id", "label", "x", "earlier", "code", "error"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in columns.schema if f.name != "code")
    return columns.mapInArrow(tidy(run), f"{kinds}, earlier binary, code binary, error long")


def changes(state: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    """part, entry, place, change: what the parts of an assigned table whose entry changed add and take, summed."""
    parts, entries, width = shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((parts * entries, width + 1), np.int64)
        for b in _blocks(batches):
            rows, x = _matrix(b.column(0), (parts, width))
            x = np.concatenate([x, np.ones((*x.shape[:2], 1), np.int64)], 2)
            now = np.frombuffer(b"".join(b.column(2).take(pa.array(rows)).to_pylist()), np.uint8).reshape(-1, parts)
            old = b.column(1).take(pa.array(rows))
            was = np.full(now.shape, -1)
            known = np.flatnonzero(old.is_valid().to_numpy(zero_copy_only=False))
            was[known] = np.frombuffer(b"".join(old.drop_null().to_pylist()), np.uint8).reshape(-1, parts)
            for sign, code in ((1, now.astype(np.int64)), (-1, was)):
                at = (was != now) & (code >= 0)
                place = (np.arange(parts) * entries + code)[at]
                own = x[at]
                for k in range(width + 1):
                    np.add.at(sums[:, k], place, sign * own[:, k])
        at = np.argwhere(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at[:, 0] // entries), pa.array(at[:, 0] % entries), pa.array(at[:, 1]), pa.array(sums[at[:, 0], at[:, 1]])], names=["part", "entry", "place", "change"])

    moved = state.where(F.col("code").isNotNull() & ~F.col("earlier").eqNullSafe(F.col("code"))).select("x", "earlier", "code")
    return moved.mapInArrow(tidy(run), "part long, entry long, place long, change long").groupBy("part", "entry", "place").agg(F.sum("change").alias("change"))


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks | None]:
    """vec_id, label, code (a byte for each part) and error (squared distance of the integers, long) of every vector kept, and the codebooks.

    A vector that is null or holds null or non-finite components is dropped. Codebooks begin as the parts of the `entries` smallest kept
    vec_ids (null last; of repeated ids the lesser vector first), or as many as there are. All vectors are as long as the first of these,
    the first whose length `parts` divides; a vector of another length, or without components, stays with a null code and error. Rows repeat
    as given, null ids and labels stay, and other columns are not read. No vectors give an empty table, and no codebooks.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code is a byte: 1 to 256 entries")
    given = vectors.select("vec_id", "label", "embedding")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good, told = integers(b.column(2))
            kept = pa.array(good)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(kept), b.column(1).filter(kept), told], names=["vec_id", "label", "x"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in given.schema if f.name != "embedding")
    told = given.mapInArrow(tidy(run), f"{kinds}, x array<int>")
    least = told.where((F.size("x") > 0) & (F.size("x") % parts == 0)).orderBy(F.asc_nulls_last("vec_id"), "x").select("x")
    first = [r["x"] for r in least.limit(entries).collect()]
    if not first:
        return told.select("vec_id", "label", F.lit(None).cast("binary").alias("code"), F.lit(None).cast("long").alias("error")), None
    if len({len(x) for x in first}) > 1:
        first = [r["x"] for r in least.where(F.size("x") == len(first[0])).limit(entries).collect()]
    books = Codebooks.of(first, parts)
    state = told.withColumn("code", F.lit(None).cast("binary"))
    for k in range(rounds):
        now = written(assigned(state, books), "vector-codes")
        books.add([tuple(r) for r in changes(now, books.entries.shape).collect()])  # parts x entries x (width + 1) rows at most
        if k:
            forget(state)
        state = now
    return assigned(state, books).select("vec_id", "label", "code", "error"), books


def decoded(coded: DataFrame, books: Codebooks) -> DataFrame:
    """coded with the vectors that its codes stand for (array of double, the middles of the integers' intervals); null for a null code."""
    held, at, name = coded.sparkSession.sparkContext.broadcast(books.entries), coded.columns.index("code"), free_name(coded, "embedding")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = held.value
        for b in batches:
            made = [None if c is None else (entries[np.arange(len(entries)), np.frombuffer(c, np.uint8)].ravel() + 0.5) / SCALE for c in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.list_(pa.float64()))], names=[*b.schema.names, name])

    return coded.mapInArrow(tidy(run), StructType([*coded.schema.fields, StructField(name, ArrayType(DoubleType()))]))


def label_errors(coded: DataFrame) -> DataFrame:
    """coded with label_error, the errors summed over equal labels, nulls together.

    Sums are partial first. Labels that hold a thousandth of the rows or more, at most HOT, come back by broadcast, so that no task gets a
    hot label; the others by a join.
    """
    rows = written(coded, "vector-coded")
    sums = written(rows.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("_n")), "label-errors")
    total = rows.count()
    hot = (F.col("_n") * HOT >= total).alias("_hot")
    side = lambda keep: sums.where(keep).select(F.col("label").alias("_label"), "label_error", F.lit(True).alias("_found"))
    known = rows.join(F.broadcast(side(hot)), F.col("label").eqNullSafe(F.col("_label")), "left")
    out = [*coded.columns, "label_error"]
    rest = known.where(F.col("_found").isNull()).select(*coded.columns).join(side(~hot), F.col("label").eqNullSafe(F.col("_label")), "left")
    return known.where("_found").select(*out).unionByName(rest.select(*out))
