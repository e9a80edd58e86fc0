"""Substring deduplication by seed and extend.

Seeds: of the nine 5-word grams in any 13 words, the one of least hash is the window's anchor (winnowing). Equal windows have
equal anchors, so a repeat of 13 words always shares one; about a fifth of all positions are anchors. Anchors of one document
only are dropped by an aggregate over (anchor, document).

Extension: documents are joined on the anchors that they share. An occurrence brings the words around its anchor, as far as the anchor
stands for the windows there. Occurrences of one anchor meet in the order of doc_id, and each is extended to the left and right
of the seed, word by word, against the earlier ones: all at once, through the windows of words that those have left. No pair of
occurrences is ever listed, however many share an anchor. What matches is merged with its neighbours into maximal repeats of at
least 13 words. Words are compared, not hashes.

Skew: anchors of very many documents are dealt out over salts, in number by their frequency, so that a group of
occurrences has a few thousand rows at most. Windows that no smaller document of their salt has go on to a second
comparison over all salts, one row for each salt and window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BLOOM_BITS, WordHashes, bloom, grams, in_bloom, slices, stirred, tidy, words_of, written

LENGTH, SEED = 13, 5
#: Anchors of more than 2^HOT[k] documents are dealt over 2^(4 (k + 1)) salts.
HOT = (9, 13, 17, 21, 25)
#: Windows that one row brings at most.
MOST_WINDOWS = 32


def anchors(h: np.ndarray, length: int = LENGTH, seed: int = SEED) -> np.ndarray:
    """For word hashes h: the hash of the anchor of each window of `length` words; empty if there is no window."""
    if len(h) < length:
        return np.empty(0, np.uint64)
    return np.lib.stride_tricks.sliding_window_view(grams(h, seed), length - seed + 1).min(1)


def seeds(docs: DataFrame, length: int, seed: int) -> DataFrame:
    """(anchor, doc_id), distinct within a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes(100_000)
        for b in slices(batches, 1, 1 << 21):
            found = [np.unique(anchors(hashes.of(words_of(x)), length, seed)) if x else np.empty(0, np.uint64) for x in b.column(1).to_pylist()]
            ids = np.repeat(b.column(0).to_numpy(), [len(x) for x in found])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64) if found else np.empty(0, np.int64)), pa.array(ids)], names=["anchor", "doc_id"])

    return docs.mapInArrow(tidy(run), "anchor long, doc_id long")


def occurrences(docs: DataFrame, shared: np.ndarray | None, hot: list[np.ndarray], length: int, seed: int) -> DataFrame:
    """(anchor, salt, doc_id, version, start, words): for each run of windows that one anchor stands for, its first window's place and all its words.

    shared: a filter of the anchors that several documents have; None lets all through. hot: filters of the frequent ones, by level; what
    they let through wrongly is dealt over salts without need. salt is 0 unless the anchor is hot.
    """
    held = docs.sparkSession.sparkContext.broadcast((shared, hot))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared, hot = held.value
        hashes = WordHashes(100_000)
        for b in slices(batches, 1, 1 << 20):
            found, said = [], []
            for doc, text, version in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                words = words_of(text)
                a = anchors(hashes.of(words), length, seed)
                if not len(a):
                    continue
                first = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
                size = np.diff(np.append(first, len(a)))
                if shared is not None:
                    ok = in_bloom(shared, a[first])
                    first, size = first[ok], size[ok]
                if (size > MOST_WINDOWS).any():
                    times = -(-size // MOST_WINDOWS)
                    nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                    size = np.minimum(np.repeat(size, times) - nth * MOST_WINDOWS, MOST_WINDOWS)
                    first = np.repeat(first, times) + nth * MOST_WINDOWS
                if len(first):
                    found.append((a[first], np.full(len(first), doc, np.int64), np.full(len(first), version, np.int64), first))
                    said += [b" ".join(words[s:e]) for s, e in zip(first.tolist(), (first + size + (length - 1)).tolist(), strict=True)]
            if found:
                anchor, doc, version, start = (np.concatenate(x) for x in zip(*found, strict=True))
                salts = np.ones(len(anchor), np.int64)
                for k, level in enumerate(hot):
                    salts[in_bloom(level, anchor)] = 1 << 4 * (k + 1)
                salt = (stirred(doc.view(np.uint64)) % salts.astype(np.uint64)).astype(np.int64) + (salts > 1)
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(salt), pa.array(doc), pa.array(version), pa.array(start), pa.array(said, pa.binary())], names=["anchor", "salt", "doc_id", "version", "start", "words"])

    return docs.mapInArrow(tidy(run), "anchor long, salt long, doc_id long, version long, start long, words binary")


def extended(rows: DataFrame, length: int) -> DataFrame:
    """Of occurrences: (doc_id, version, start, n, words). Without words: n windows from start are repeats. With words: a window of a hot anchor that no smaller document of its salt has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[] for _ in range(5)]
        key, earlier, whole = None, {}, {}

        def given() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["doc_id", "version", "start", "n", "words"])
            for x in out:
                x.clear()
            return made

        def tell(*row) -> None:
            for x, value in zip(out, row, strict=True):
                x.append(value)

        for b in batches:
            for anchor, salt, doc, version, start, said in zip(*(b.column(k).to_pylist() for k in range(6)), strict=True):
                if key != (anchor, salt):
                    key, earlier, whole = (anchor, salt), {}, {}
                # The same words around the seed have come with a smaller document: all of them are a repeat.
                if whole.setdefault(said, doc) < doc:
                    tell(doc, version, start, said.count(b" ") + 2 - length, None)
                    continue
                words, first = said.split(b" "), None
                for k in range(len(words) - length + 1):
                    window = b" ".join(words[k : k + length])
                    if earlier.setdefault(window, doc) < doc:
                        first = k if first is None else first
                    else:
                        if first is not None:
                            tell(doc, version, start + first, k - first, None)
                            first = None
                        if salt:
                            tell(doc, version, start + k, 1, window)
                if first is not None:
                    tell(doc, version, start + first, len(words) - length + 1 - first, None)
            if len(out[0]) > 50_000:
                yield given()
        yield given()

    ordered = rows.repartition("anchor", "salt").sortWithinPartitions("anchor", "salt", "doc_id", "start")
    return ordered.mapInArrow(tidy(run), "doc_id long, version long, start long, n long, words binary")


def repeats(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """(doc_id, version, starts, counts): runs of windows (first place, number) of a document whose words also start in a document with a smaller doc_id.

    version is a hash of the text: the documents of one doc_id with several texts are told apart by it.
    """
    docs = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("version"))
    every = seeds(docs.select("doc_id", "text"), length, seed).groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z"), F.count("*").alias("n"))
    shared = written(every.where(F.col("a") < F.col("z")).select("anchor", "n"), "anchors")
    levels = [F.count_if(F.col("n") > (1 << k)).alias(str(k)) for k in HOT]
    told = shared.agg(F.count("*").alias("all"), *levels).first()
    hot = [bloom(shared.where(F.col("n") > (1 << k)), "anchor", told[str(k)]) for k in HOT if told[str(k)]]
    if 8 * told["all"] <= BLOOM_BITS:
        found = occurrences(docs, bloom(shared, "anchor", told["all"]), hot, length, seed)
    else:  # a filter of so many values would let most others through too
        found = occurrences(docs, None, hot, length, seed).join(shared.select("anchor"), "anchor", "left_semi")
    first = written(extended(found, length), "extended")
    sure = first.where(F.col("words").isNull()).select("doc_id", "version", "start", "n")
    rest = first.where(F.col("words").isNotNull()).withColumn("least", F.min("doc_id").over(Window.partitionBy("words")))
    rest = rest.where(F.col("doc_id") > F.col("least")).select("doc_id", "version", "start", "n")
    return sure.unionByName(rest).groupBy("doc_id", "version").agg(F.collect_list(F.struct("start", "n")).alias("runs")).select("doc_id", "version", F.col("runs.start").alias("starts"), F.col("runs.n").alias("counts"))


def maximal_repeats(found: DataFrame, length: int = LENGTH) -> DataFrame:
    """Of repeats(): (doc_id, start, n_words), the maximal repeats: neighbouring and overlapping ones are one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc, starts, counts in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                at, n = starts.values.to_numpy(), counts.values.to_numpy()
                gone = np.append(False, covered(int((at + n).max()) + length - 1, at, n, length)).astype(np.int8)
                edges = np.flatnonzero(np.diff(np.append(gone, 0)))
                rows += [(doc, s, e - s) for s, e in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], names=["doc_id", "start", "n_words"])

    return found.select("doc_id", "starts", "counts").mapInArrow(tidy(run), "doc_id long, start long, n_words long")


def covered(n: int, starts: np.ndarray, counts: np.ndarray, length: int) -> np.ndarray:
    """Which of n words lie in a window of one of the runs."""
    edge = np.zeros(n + length + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + counts + (length - 1), n), -1)
    return np.cumsum(edge)[:n] > 0


def substring_dedup(docs: DataFrame, length: int = LENGTH, seed: int = SEED, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and kept_text if asked for), one row for each row given.

    A null or empty text has no words; texts of fewer than `length` words lose none. Repeats within one document, and between
    rows of one doc_id, are left alone; rows that share a doc_id but not their text are judged each by its own text. Rows without a
    doc_id are neither compared nor changed. Other columns are not read. An empty table gives an empty table.
    """
    found = written(repeats(docs, length, seed), "starts")
    ids = docs.sparkSession.sparkContext.broadcast(bloom(found, "doc_id", found.count()))
    kinds = "n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("version"))

    def result(words: list[bytes], gone: np.ndarray | None) -> tuple:
        kept = words if gone is None else [w for w, x in zip(words, gone.tolist(), strict=True) if not x]
        said = b" ".join(kept)
        return len(words), len(words) - len(kept), hashlib.sha256(said).hexdigest(), *([said.decode("utf-8", "surrogatepass")] * with_text)

    def arrays(rows: list[tuple]) -> list[pa.Array]:
        types = [pa.int64(), pa.int64(), pa.string(), pa.string()][: 3 + with_text]
        return [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]

    # Texts without a repeat are done at once; the others travel to their starts. Either way the text is read once.
    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "text", "version", *(x.split()[0] for x in kinds.split(", "))]
        for b in slices(batches, 1, 1 << 21):
            may = b.column(0).is_valid().to_numpy(zero_copy_only=False) & in_bloom(ids.value, b.column(0).fill_null(0).to_numpy().view(np.uint64))
            texts = b.column(1).to_pylist()
            rows = [(None,) * (3 + with_text) if m else result(words_of(x), None) for x, m in zip(texts, may, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x or "" if m else None for x, m in zip(texts, may, strict=True)], pa.string()), b.column(2), *arrays(rows)], names=names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 3 + 3 + with_text
        for b in slices(batches, 1, 1 << 21):
            rows = []
            for k, (text, starts, counts) in enumerate(zip(b.column(1).to_pylist(), b.column(at), b.column(at + 1), strict=True)):
                if text is None:
                    rows.append(tuple(b.column(c)[k].as_py() for c in range(3, at)))
                else:
                    words = words_of(text)
                    rows.append(result(words, covered(len(words), starts.values.to_numpy(), counts.values.to_numpy(), length) if starts.is_valid else None))
            yield pa.RecordBatch.from_arrays([b.column(0), *arrays(rows)], names=["doc_id", *(x.split()[0] for x in kinds.split(", "))])

    # Starts compress so well that the size of their files says nothing of their size in memory: no broadcast.
    found = found.withColumnsRenamed({"doc_id": "_id", "version": "_version"}).hint("merge")
    told = rows.mapInArrow(tidy(clean), f"doc_id long, text string, version long, {kinds}").join(found, (F.col("doc_id") == F.col("_id")) & (F.col("version") == F.col("_version")), "left").drop("_id", "_version")
    return told.mapInArrow(tidy(cut), f"doc_id long, {kinds}")
