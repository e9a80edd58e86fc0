"""What the operators share: the word rule, batches bounded in bytes, hashing, written tables, Bloom filters."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a longest run of anything but these six white-space characters.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
MASK = (1 << 64) - 1
_SPACE = re.compile(SPACE_CLASS.encode())


def words_of(text: str | None) -> list[bytes]:
    """The words of a text in UTF-8: bytes.split() breaks at exactly the six characters of SPACE_CLASS."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def pieces(raw: bytes, most: int = 1 << 20, most_word: int | None = None) -> Iterator[bytes]:
    """A text in pieces of about `most` bytes, cut where white space is (which goes with the piece before it), so that words are whole; a word that goes on for more than most_word bytes there is cut."""
    at = 0
    while len(raw) - at > most:
        cut = _SPACE.search(raw, at + most, at + most + most_word if most_word else len(raw))
        end = cut.end() if cut else at + most + most_word if most_word else len(raw)
        yield raw[at:end]
        at = end
    if at < len(raw):
        yield raw[at:]


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; set here only in local mode, where the session names none (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="attest-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage, and outlives any executor."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/attest-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._attest_path = path
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return out


#: Tables that written() has made and nobody has deleted, by application.
_made: dict[str, list[str]] = {}


def _delete(spark: SparkSession, paths: list[str]) -> None:
    jvm, held = spark._jvm, _made.get(spark.sparkContext.applicationId, [])
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        if path in held:
            held.remove(path)


def forget(*tables: DataFrame) -> None:
    """Deletes tables of written() that nothing reads any more."""
    for t in tables:
        _delete(t.sparkSession, [t._attest_path])


class Scratch:
    """with Scratch(spark): every table that written() makes inside is deleted at the end. What is built on them must have been written by then."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark

    def __enter__(self) -> None:
        self.before = set(_made.get(self.spark.sparkContext.applicationId, []))

    def __exit__(self, *_: object) -> None:
        _delete(self.spark, [p for p in _made.get(self.spark.sparkContext.applicationId, []) if p not in self.before])


def slices(batches: Iterator[pa.RecordBatch], text: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts record batches so that the texts of one slice (column number text) have about `most` bytes; a longer text comes alone."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
            yield batch.slice(at, to - at)
            at = to


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which a worker gives memory that it no longer needs back to the system: workers are used again, and keep it otherwise."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # a C library without it
            ctypes.CDLL(None).malloc_trim(0)

    return tidied


class WordHashes(dict):
    """word -> 64-bit hash, remembering up to `most` words."""

    def __init__(self, most: int = 200_000, lower: bool = False) -> None:
        super().__init__()
        self.most, self.lower = most, lower

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word.lower() if self.lower else word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def stirred(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


#: Powers of an odd number, and of its inverse, modulo 2^64, for places within a chunk.
_BASE, _CHUNK = 0xD1342543DE82EF95, 1 << 16
_POWERS, _INVERSES = (np.cumprod(np.append(np.uint64(1), np.full(_CHUNK - 1, x, np.uint64))) for x in (_BASE, pow(_BASE, -1, 1 << 64)))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each span, from sums over the bytes before its ends: for statistics, not where a collision would change a result that must be exact."""
    before = []
    for places in (starts, ends):
        out, total = np.empty(len(places), np.uint64), np.uint64(0)
        for k, at in enumerate(range(0, len(data) + 1, _CHUNK)):
            part = data[at : at + _CHUNK]
            sums = np.append(np.uint64(0), np.cumsum((part.astype(np.uint64) + np.uint64(1)) * _POWERS[: len(part)]))
            a, b = np.searchsorted(places, (at, at + _CHUNK))
            scale = np.uint64(pow(_BASE, k * _CHUNK, 1 << 64))
            out[a:b] = total + scale * sums[places[a:b] - at]
            total = np.uint64((int(total) + int(scale) * int(sums[-1])) & MASK)
        before.append(out)
    chunk = starts >> 16
    back = np.array([pow(_BASE, -int(k) * _CHUNK, 1 << 64) for k in range(int(chunk.max(initial=0)) + 1)], np.uint64)
    return stirred((before[1] - before[0]) * _INVERSES[starts & (_CHUNK - 1)] * back[chunk] + (ends - starts).astype(np.uint64))


def grams(h: np.ndarray, k: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """A hash for each k consecutive entries of h (fewer than k: none)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out, power = np.zeros(n, np.uint64), 1
    for j in range(k):
        out += h[j : j + n] * np.uint64(power)
        power = power * (base | 1) & MASK
    return stirred(out)


# --- Bloom filters of a bounded size: only ever a first sieve before an exact join ---

#: A value sets two bits of one block, so that each block is made by one task from its own values.
BLOOM_BLOCK, BLOOM_BITS = 1 << 16, 1 << 29


def _bits(h: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The block of each value, and its two bits there."""
    h = stirred(h.astype(np.uint64))
    low = np.uint64(BLOOM_BLOCK - 1)
    return ((h >> np.uint64(32)) % np.uint64(blocks)).astype(np.int64), (h & low).astype(np.int64), ((h >> np.uint64(16)) & low).astype(np.int64)


def bloom(df: DataFrame, column: str, count: int, most_bits: int = BLOOM_BITS) -> np.ndarray:
    """A Bloom filter (packed bits) of a long column: about 16 bits a value up to most_bits (64 MB). Beyond that it lets more through, and never loses a value.

    Values are dealt out by block, a task holds the blocks of its own values, and the driver gets the finished blocks.
    """
    blocks = -(-min(max(16 * count, 1), most_bits) // BLOOM_BLOCK)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = b.column(0).drop_null().to_numpy(zero_copy_only=False).astype(np.int64)
            block, one, two = _bits(h.view(np.uint64), blocks)
            yield pa.RecordBatch.from_arrays([pa.array(block), pa.array(one << 16 | two)], names=["block", "bits"])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            block, bits = b.column(0).to_numpy(), b.column(1).to_numpy()
            order = np.argsort(block, kind="stable")
            block, bits = block[order], bits[order]
            starts = np.flatnonzero(np.append(True, block[1:] != block[:-1])) if len(block) else []
            for part, k in zip(np.split(bits, starts[1:]), block[starts].tolist()) if len(block) else ():
                own = held.setdefault(k, np.zeros(BLOOM_BLOCK // 8, np.uint8))
                for at in (part >> 16, part & BLOOM_BLOCK - 1):
                    np.bitwise_or.at(own, at >> 3, (128 >> (at & 7)).astype(np.uint8))
        for k, own in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([own.tobytes()], pa.binary())], ["block", "bits"])

    parts = df.select(column).mapInArrow(tidy(deal), "block long, bits long").repartition("block").mapInArrow(tidy(mark), "block long, bits binary")
    out = np.zeros((blocks, BLOOM_BLOCK // 8), np.uint8)
    for r in parts.toLocalIterator():
        out[r["block"]] = np.frombuffer(r["bits"], np.uint8)
    return out.ravel()


def in_bloom(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    block, one, two = _bits(h, len(bits) * 8 // BLOOM_BLOCK)
    block *= BLOOM_BLOCK // 8
    return ((bits[block + (one >> 3)] >> (7 - (one & 7)).astype(np.uint8)) & (bits[block + (two >> 3)] >> (7 - (two & 7)).astype(np.uint8)) & 1).astype(bool)


def sieve(df: DataFrame, column: str, bits: np.ndarray) -> DataFrame:
    """The rows of df whose `column` may be in the filter."""
    held = df.sparkSession.sparkContext.broadcast(bits)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index(column)
            ids = b.column(at).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            yield b.filter(pa.array(in_bloom(held.value, ids)))

    return df.mapInArrow(tidy(keep), df.schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, want: str) -> str:
    """A column name that df does not have yet."""
    taken = {c.lower() for c in df.columns}
    while want.lower() in taken:
        want += "_"
    return want


Query = Callable[[SparkSession, str], DataFrame]
__all__ = ["BLOOM_BITS", "F", "Scratch", "forget", "Query", "WORD_PATTERN", "SPACE_CLASS", "WordHashes", "bloom", "free_name", "grams", "in_bloom", "pieces", "shared_folder", "sieve", "slices", "span_hashes", "stirred", "table", "tidy", "words_of", "written"]
