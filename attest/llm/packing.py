"""Packing token streams into sequences of fixed width by cutting-stock column generation.

A document is cut at every full width; what is left is cut once more into a multiple of STEP and a rest below STEP, so that
piece lengths come from a small fixed set whatever the corpus. The driver sees the length histogram only (at most
WIDTH / STEP + STEP numbers): a linear program over patterns (multisets of lengths that fit one sequence) is solved by
column generation, where a knapsack dynamic program prices new patterns. The solution is rounded down; the few pieces left
over are packed first-fit decreasing, which gives patterns as well. Pieces of one length are ranked over the whole corpus,
and the rank alone tells a piece its pattern, its copy of it and its offset: nothing is grouped by sequence.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, tidy, written

WIDTH, STEP, END_ID = 2048, 64, 1


# --- tokens ---


def byte_of_character() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabulary files use: printable Latin-1 stands for itself, the rest counts up from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def encoder(path: str, pattern: str) -> tuple[tiktoken.Encoding, dict[str, int]]:
    """The encoding of a byte-level BPE file whose ids follow the order of its merges, and its added tokens: their strings have ids of their own wherever they stand."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    added = {x["content"]: x["id"] for x in model.get("added_tokens", ())}
    if odd := [x["content"] for x in model.get("added_tokens", ()) if x.get("lstrip") or x.get("rstrip") or x.get("single_word")]:
        raise ValueError(f"added tokens that take their surroundings are not supported: {odd}")
    of = byte_of_character()
    ranks = {bytes(of[c] for c in piece): k for piece, k in model["model"]["vocab"].items() if piece not in added}
    return tiktoken.Encoding("attest", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), added


class Encoder:
    """text -> little-endian 32-bit ids as bytes.

    A text is first cut at the strings of added tokens (the leftmost, then the longest), which have their own ids; what lies
    between is encoded by itself. The pattern always breaks before a single space between two other characters, so such a
    part is the sum of its chunks there; chunks recur, and their ids are remembered (up to `most`).
    """

    #: Python's white space holds all that the pattern takes for white space.
    RUN = re.compile(r"\s\s")
    BREAK = re.compile(r"(?<=\S) (?=\S)")

    def __init__(self, path: str, pattern: str, most: int = 150_000) -> None:
        encoding, added = encoder(path, pattern)
        self.of, self.most, self.known = encoding.encode_ordinary, most, {}
        self.added = {x: array("I", [k]).tobytes() for x, k in added.items()}
        self.cut = re.compile(f"({'|'.join(map(re.escape, sorted(added, key=len, reverse=True)))})") if added else None

    def chunk(self, text: str) -> bytes:
        return array("I", self.of(text)).tobytes()

    def encode(self, text: str) -> bytes:
        if not any(x in text for x in self.added):
            return self.plain(text)
        parts = self.cut.split(text)
        return b"".join(self.added[x] if k % 2 else self.plain(x) for k, x in enumerate(parts) if x)

    def plain(self, text: str) -> bytes:
        first, *rest = self.BREAK.split(text) if self.RUN.search(text) else text.split(" ")
        known = self.known
        out = list(map(known.get, rest))
        if None in out:
            if len(known) > self.most:
                known.clear()
            for k, x in enumerate(out):
                if x is None:
                    if (got := known.get(rest[k])) is None:
                        got = known[rest[k]] = self.chunk(" " + rest[k])
                    out[k] = got
        return self.chunk(first) + b"".join(out)


def cuts(n: int, width: int = WIDTH, step: int = STEP) -> list[int]:
    """Lengths of the pieces of n tokens, in order."""
    rest = n % width
    return [width] * (n // width) + [x for x in (rest - rest % step, rest % step) if x]


def pieces(docs: DataFrame, path: str, pattern: str, width: int = WIDTH, step: int = STEP) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = None, array("I", [END_ID]).tobytes()
        for b in slices(batches, 1):
            encode = encode or Encoder(path, pattern).encode
            which, start, length, crc, total = [], [], [], [], []
            for k, text in enumerate(b.column(1).to_pylist()):
                ids = (encode(text) if text else b"") + end
                at, n = 0, len(ids) // 4
                for x in cuts(n, width, step):
                    which.append(k), start.append(at), length.append(x), total.append(n)
                    crc.append(zlib.crc32(ids[4 * at : 4 * (at + x)]))
                    at += x
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(which, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long")


# --- patterns ---


def best_pattern(lengths: list[int], worth: np.ndarray, width: int) -> tuple[float, dict[int, int]]:
    """Unbounded knapsack: the worthiest multiset of lengths (by index) that fits, and what it is worth."""
    size = np.array(lengths)
    best, choice = np.zeros(width + 1), np.full(width + 1, -1)
    for w in range(1, width + 1):
        room = w - size
        value = np.where(room >= 0, best[np.maximum(room, 0)] + worth, -np.inf)
        k = int(value.argmax())
        best[w], choice[w] = (value[k], k) if value[k] > best[w - 1] + 1e-12 else (best[w - 1], -1)
    out: dict[int, int] = {}
    w = width
    while w > 0:
        if (k := choice[w]) < 0:
            w -= 1
        else:
            out[k] = out.get(k, 0) + 1
            w -= lengths[k]
    return float(best[width]), out


def solve(lengths: list[int], counts: list[int], width: int, most_rounds: int = 2000) -> list[tuple[dict[int, int], float]]:
    """The linear program by column generation in a revised simplex: patterns of a basis, and how often each is used.

    Each round prices by the knapsack; it ends when no pattern is worth more than a sequence. Should most_rounds end it
    first, the basis is feasible all the same, only with more padding.
    """
    m = len(lengths)
    demand = np.array(counts, float)
    basis = [{k: width // x} for k, x in enumerate(lengths)]
    inverse = np.diag([1 / (width // x) for x in lengths])
    amount = inverse @ demand
    for _ in range(most_rounds):
        value, pattern = best_pattern(lengths, np.maximum(inverse.sum(0), 0), width)
        if value <= 1 + 1e-7:
            break
        column = np.zeros(m)
        for k, n in pattern.items():
            column[k] = n
        along = inverse @ column
        able = along > 1e-9
        if not able.any():
            break
        ratio = np.where(able, amount / np.where(able, along, 1), np.inf)
        out = int(ratio.argmin())
        pivot = inverse[out] / along[out]
        inverse -= np.outer(along, pivot)
        inverse[out] = pivot
        basis[out] = pattern
        amount = np.maximum(inverse @ demand, 0)
    return list(zip(basis, amount, strict=True))


def plan(histogram: dict[int, int], width: int = WIDTH) -> list[tuple[dict[int, int], int]]:
    """(length -> pieces of a sequence, number of such sequences): uses every piece of the histogram exactly once."""
    out = [({width: 1}, histogram[width])] if histogram.get(width) else []
    left = {x: n for x, n in sorted(histogram.items(), reverse=True) if n and x != width}
    if left:
        lengths = list(left)
        for pattern, amount in solve(lengths, [left[x] for x in lengths], width):
            # rounded down, and never more than what is left
            n = min([int(amount + 1e-6), *(left[lengths[k]] // need for k, need in pattern.items())])
            if n > 0:
                out.append(({lengths[k]: need for k, need in pattern.items()}, n))
                for k, need in pattern.items():
                    left[lengths[k]] -= n * need
    bins: list[list] = []
    for x, n in left.items():  # longest first
        for _ in range(n):
            fit = min((b for b in bins if b[0] >= x), key=lambda b: b[0], default=None)
            if fit is None:
                bins.append(fit := [width, {}])
            fit[0] -= x
            fit[1][x] = fit[1].get(x, 0) + 1
    return out + [(b[1], 1) for b in bins]


def slots(patterns: list[tuple[dict[int, int], int]]) -> np.ndarray:
    """Rows (length, first rank, pieces in a sequence, first sequence, first offset), sorted by length and rank."""
    rows, used, sequence = [], {}, 0
    for pattern, n in patterns:
        offset = 0
        for x, need in pattern.items():
            rows.append((x, used.get(x, 0), need, sequence, offset))
            used[x] = used.get(x, 0) + n * need
            offset += x * need
        sequence += n
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


# --- the operator ---


def pack(docs: DataFrame, path: str, pattern: str, width: int = WIDTH, step: int = STEP, rows_a_rank_task: int = 20_000) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is its end id alone. A row that is repeated is packed as often as it comes; ties of rank are
    between rows that are equal in doc_id, start and ids, so that any order gives the same rows. doc_id may be null. Other
    columns are not read. An empty table gives an empty table. Sequences are filled to the width but for a few, which
    hold what rounding left.
    """
    spark = docs.sparkSession
    cut = written(pieces(docs, path, pattern, width, step), "pieces")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most width / step + step rows
    found = slots(plan(counts, width))
    salts = int(max(1, min(1 << 16, sum(counts.values()) // rows_a_rank_task)))
    cut = cut.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(salts)))
    before = cut.groupBy("length", "_salt").agg(F.count("*").alias("_n")).withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_salt")) - F.col("_n")).drop("_n")
    order = Window.partitionBy("length", "_salt").orderBy("doc_id", "start", "ids_crc32")
    ranked = cut.withColumn("_rank", F.row_number().over(order) - 1).join(before, ["length", "_salt"]).withColumn("_rank", F.col("_rank") + F.col("_before"))
    held = spark.sparkContext.broadcast(found)  # a row for each pattern and length in it: bounded by the number of lengths
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = held.value
        keys = (table[:, 0] << 50) + table[:, 1]
        for b in batches:
            length, rank = (b.column(k).to_numpy() for k in (2, 5))
            row = table[np.searchsorted(keys, (length << 50) + rank, "right") - 1] if len(table) else np.empty((0, 5), np.int64)
            at = rank - row[:, 1]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(row[:, 3] + at // row[:, 2]), pa.array(row[:, 4] + at % row[:, 2] * length)], names=[*names, "sequence_id", "offset"])

    return ranked.select(*names, F.col("_rank").cast("long")).mapInArrow(tidy(place), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {', '.join(f'{x} long' for x in [*names[1:], 'sequence_id', 'offset'])}")
