"""Quality rules as a bitmask ledger: every rule is judged once, policies and ablations read the bits.

`ledger` measures a text and stores one bit for each rule that it fails. A policy is a version name and a mask of the rules
that reject. Policies, and the question of what each rule does alone, are then bitwise work on the ledger; texts are not
read again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, grams, pieces, slices, tidy

SPACES, SYMBOLS = b" \t\n\r\x0b\x0c", b"#*$%&|<>"
CAPITALS = bytes(range(65, 91))
NO_LETTERS = bytes(k for k in range(128) if not chr(k).isalpha())
WINDOW = 5

#: Rules by bit. Each is told from the measurements alone.
RULES = {
    "few_words": lambda m: m["n_words"] < 10,
    "repeated_windows": lambda m: 100 * m["n_repeat_words"] > 20 * m["n_words"],
    "symbols": lambda m: 100 * m["n_symbols"] > 7 * m["word_chars"],
    "repeated_lines": lambda m: m["n_dup_lines"] >= 3 and 100 * m["n_dup_lines"] > 50 * m["n_lines"],
    "shouting": lambda m: m["n_letters"] >= 50 and 100 * m["n_upper"] > 70 * m["n_letters"],
    "few_letters": lambda m: m["word_chars"] > 0 and 100 * m["n_letters"] < 30 * m["word_chars"],
    "stuttering": lambda m: 100 * m["n_stutters"] > 30 * m["n_words"],
}
BIT = {name: 1 << k for k, name in enumerate(RULES)}
#: Version -> rules that reject.
POLICIES = {
    "v1": ("few_words", "repeated_windows"),
    "v2": ("few_words", "repeated_windows", "symbols", "repeated_lines"),
    "v3": tuple(RULES),
}
LATEST = "v3"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_upper", "n_stutters")


def line_hashes(raw: bytes) -> np.ndarray:
    """A hash of each line (split at \\n) that has a word, in order."""
    out, line, told = [], xxhash.xxh64(), False
    for piece in pieces(raw):
        first, *others = piece.split(b"\n")
        line.update(first)
        told |= bool(first.strip(SPACES))
        if others:
            own = [xxhash.xxh64_intdigest(x) for x in others[:-1] if x.strip(SPACES)]
            out.append(np.array([line.intdigest()] * told + own, np.uint64))
            line, told = xxhash.xxh64(others[-1]), bool(others[-1].strip(SPACES))
    out.append(np.array([line.intdigest()] * told, np.uint64))
    return np.concatenate(out)


def repeated_words(h: np.ndarray) -> int:
    """For hashes of words: how many lie in a window of WINDOW words that is found again."""
    windows = grams(h, WINDOW)
    order = np.argsort(windows, kind="stable")
    same = windows[order[1:]] == windows[order[:-1]]
    if not same.any():
        return 0
    edge = np.zeros(len(h) + 1, np.int32)
    for at in (order[1:][same], order[:-1][same]):
        edge[at] = 1  # a window that is found again begins here
    begun = np.cumsum(edge)
    return int((begun[:-1] > np.concatenate([np.zeros(WINDOW, np.int32), begun])[: len(h)]).sum())


def measured(text: str | None, hashes: WordHashes | None = None) -> dict[str, int]:
    """Counts over the whole text. Words are split at six ASCII white-space characters, lines at \\n; equal words, lines and windows are told by 64-bit hashes, so that a long text takes some 50 bytes a word."""
    if not text:
        return dict.fromkeys(MEASURES, 0)
    hashes = WordHashes() if hashes is None else hashes
    raw = text.encode("utf-8", "surrogatepass")
    h = np.concatenate([np.empty(0, np.uint64), *(hashes.of(p.split()) for p in pieces(raw))])
    lines = line_hashes(raw)
    if raw.isascii():
        letters, upper = len(raw.translate(None, NO_LETTERS)), len(raw) - len(raw.translate(None, CAPITALS))
    else:
        letters, upper = sum(map(str.isalpha, text)), sum(map(str.isupper, text))
    return {
        "n_words": len(h),
        "word_chars": len(text) - (len(raw) - len(raw.translate(None, SPACES))),
        "n_symbols": len(raw) - len(raw.translate(None, SYMBOLS)),
        "n_dup_lines": len(lines) - len(np.unique(lines)),
        "n_repeat_words": repeated_words(h),
        "n_lines": len(lines),
        "n_letters": letters,
        "n_upper": upper,
        "n_stutters": int((h[1:] == h[:-1]).sum()),
    }


def failed(m: dict[str, int]) -> int:
    return sum(BIT[name] for name, rule in RULES.items() if rule(m))


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, MEASURES and fail_bits, one row for each row given.

    A null or empty text has no words, lines or letters, and fails few_words only. Rows repeat as given; null doc_ids stay;
    other columns are not read; an empty table gives an empty table.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in slices(batches, 1):
            got = [measured(x, hashes) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([m[k] for m in got], pa.int64()) for k in MEASURES), pa.array(map(failed, got), pa.int64())], names=["doc_id", *MEASURES, "fail_bits"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), f"doc_id {kind}, {', '.join(f'{k} long' for k in MEASURES)}, fail_bits long")


def mask(version: str) -> int:
    return sum(BIT[x] for x in POLICIES[version])


def with_policy(rows: DataFrame, version: str = LATEST) -> DataFrame:
    """A ledger with base_failed and kept under a policy; kept is never true where base_failed is."""
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return rows.withColumn("base_failed", base).withColumn("kept", ~base & (F.col("fail_bits").bitwiseAND(F.lit(mask(version))) == 0))


def ablations(rows: DataFrame, version: str = LATEST) -> DataFrame:
    """For each rule of a policy: rows it fails, rows that only it fails (what leaving it out would keep), rows the policy rejects.

    One pass with a partial aggregate: bits are tested, nothing is judged anew.
    """
    m = mask(version)
    held = F.col("fail_bits").bitwiseAND(F.lit(m))
    aggs = [F.count_if(held != 0).alias("rejected")]
    for name in POLICIES[version]:
        aggs += [F.count_if(held.bitwiseAND(F.lit(BIT[name])) != 0).alias(f"{name}__fails"), F.count_if(held == BIT[name]).alias(f"{name}__alone")]
    one = rows.agg(*aggs)
    pairs = F.array(*(F.struct(F.lit(name).alias("rule"), F.col(f"{name}__fails").alias("fails"), F.col(f"{name}__alone").alias("alone")) for name in POLICIES[version]))
    return one.select(F.lit(version).alias("policy"), "rejected", F.inline(pairs))


def quality_filter(docs: DataFrame, version: str = LATEST) -> DataFrame:
    """The rows of docs that the policy keeps, with the columns of docs and their values, whatever they are called; judged in the pass that reads them, so nothing is joined.

    A null or empty text has no words and goes under every policy; repeated rows stay or go together; doc_id is not read; an empty table
    gives an empty table.
    """
    at, m = docs.columns.index("text"), mask(version)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in slices(batches, at):
            yield b.filter(pa.array([not failed(measured(x, hashes)) & m for x in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)
