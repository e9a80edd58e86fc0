"""Fill-in-the-middle: a text is cut in two places, and its middle is told last.

Token boundaries are a packed bitvector over the bytes of a whole batch of texts, with a directory of the ones before each block.
rank (ones before a byte) of a text's two ends gives its number of tokens; select (the byte of the k-th one) of two ranks gives
its cuts. No token is ever made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, tidy

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 texts so many stay plain; of 100 others so many are told with the suffix first.
PLAIN_PERCENT, SUFFIX_FIRST_PERCENT = 10, 20

#: Bits are packed so many bytes of text at a time, so that flags of a long text are never held unpacked.
CHUNK = 1 << 20

_LETTER = np.zeros(256, bool)
_LETTER[ord("A") : ord("Z") + 1] = _LETTER[ord("a") : ord("z") + 1] = True
#: Bytes that go on with a code point of UTF-8.
_INNER = np.zeros(256, bool)
_INNER[0x80:0xC0] = True


class Bits:
    """A packed bitvector with the number of ones before each block of 64 bytes: rank and select of many places at once."""

    BLOCK = 64

    def __init__(self, packed: np.ndarray, size: int) -> None:
        blocks = len(packed) // self.BLOCK + 1
        self.packed = np.zeros(blocks * self.BLOCK, np.uint8)
        self.packed[: len(packed)] = packed
        ones = np.bitwise_count(self.packed.view(np.uint64)).reshape(blocks, -1).sum(1, dtype=np.int64)
        self.before = np.concatenate([[0], np.cumsum(ones)])
        self.size = size

    def __len__(self) -> int:
        """All ones."""
        return int(self.before[-1])

    def _inside(self, block: np.ndarray) -> np.ndarray:
        """Ones before each byte of the blocks given, one row a block."""
        ones = np.bitwise_count(self.packed.reshape(-1, self.BLOCK)[block])
        return np.cumsum(ones, 1, dtype=np.int64) - ones

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before the places given (0 to size)."""
        byte = at >> 3
        block = byte // self.BLOCK
        high = self.packed[byte] >> (8 - (at & 7)).astype(np.uint8)
        return self.before[block] + self._inside(block)[np.arange(len(at)), byte % self.BLOCK] + np.bitwise_count(high)

    def select(self, k: np.ndarray) -> np.ndarray:
        """The place of the k-th one, from 0; `size` for k beyond the last."""
        out = np.full(len(k), self.size, np.int64)
        known = np.flatnonzero(k < len(self))
        k = k[known]
        block = np.searchsorted(self.before, k, "right") - 1
        left = k - self.before[block]
        inside = self._inside(block)
        byte = (inside <= left[:, None]).sum(1) - 1
        left -= inside[np.arange(len(k)), byte]
        byte += block * self.BLOCK
        bits = np.unpackbits(self.packed[byte][:, None], axis=1)
        bit = (np.cumsum(bits, 1) <= left[:, None]).sum(1)
        out[known] = byte * 8 + bit
        return out


def boundaries(data: np.ndarray, starts: np.ndarray) -> Bits:
    """A one at each byte where a token of `[A-Za-z]+|[^A-Za-z]` begins, for UTF-8 texts that follow each other and begin at `starts`."""
    packed = np.empty(-(-len(data) // 8), np.uint8)
    for at in range(0, len(data), CHUNK):
        part = data[at : at + CHUNK]
        letter, flags = _LETTER[part], ~_INNER[part]
        flags[1:] &= ~(letter[1:] & letter[:-1])
        flags[0] &= not (at and letter[0] and _LETTER[data[at - 1]])
        own = starts[np.searchsorted(starts, at) : np.searchsorted(starts, at + len(part))] - at
        flags[own] = True
        packed[at // 8 : at // 8 + -(-len(part) // 8)] = np.packbits(flags)
    return Bits(packed, len(data))


def code_points(data: np.ndarray) -> Bits:
    """A one at each byte where a code point begins."""
    chunks = [np.packbits(~_INNER[data[at : at + CHUNK]]) for at in range(0, len(data), CHUNK)]
    return Bits(np.concatenate(chunks) if chunks else np.empty(0, np.uint8), len(data))


def draws(doc_id: Column, seed: int = 1) -> list[Column]:
    """Four numbers below 2^32 for a document, from the digest of seed and doc_id (null: nothing after the colon)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Buffer | None]:
    """The bytes of a column's texts, and the starts of all and the end of the last; null is empty."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    _, ends, data = texts.buffers()
    ends = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1] if ends is not None else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return whole[ends[0] : ends[-1]], ends - ends[0]


def _transformed(texts: pa.Array, h: list[np.ndarray], plain_percent: int, suffix_first_percent: int) -> list[list]:
    data, ends = _buffers(texts)
    bits = boundaries(data, ends[:-1])
    first = bits.rank(ends)
    n = first[1:] - first[:-1]
    one, two = h[0] % (n + 1), h[1] % (n + 1)
    # The place after the last token of a text is its end: select would give the next text's start, which is the same byte.
    cuts = [np.minimum(bits.select(first[:-1] + k), ends[1:]).tolist() for k in (np.minimum(one, two), np.maximum(one, two))]
    ranked = code_points(data)
    points = [ranked.rank(np.array(x, np.int64)) for x in (ends[:-1], *cuts)]
    stays, back = (h[2] % 100 >= 100 - plain_percent).tolist(), (h[3] % 100 < suffix_first_percent).tolist()
    p, s, m = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))
    forms, outputs, lengths = [], [], [[], []]
    raw = memoryview(data)
    for k, (start, a, b, end) in enumerate(zip(ends[:-1].tolist(), *cuts, ends[1:].tolist(), strict=True)):
        text = bytes(raw[start:end])
        if stays[k] or not text or p in text or s in text or m in text:
            forms.append("plain")
            outputs.append(text)
        else:
            head, middle, tail = text[: a - start], text[a - start : b - start], text[b - start :]
            forms.append("spm" if back[k] else "psm")
            outputs.append(b"".join((s, tail, p, head, m, middle) if back[k] else (p, head, s, tail, m, middle)))
        for j in range(2):
            lengths[j].append(None if forms[-1] == "plain" else int(points[j + 1][k] - points[j][k]))
    return [n, forms, *lengths, outputs]


def fill_middle(docs: DataFrame, seed: int = 1, plain_percent: int = PLAIN_PERCENT, suffix_first_percent: int = SUFFIX_FIRST_PERCENT) -> DataFrame:
    """doc_id, n (tokens), form (plain, psm or spm), prefix_chars, middle_chars (code points; null if plain) and output, one row for each row given.

    Whole texts, whatever their length; each is read once and what a task holds is bounded by its longest text. A null or empty text is
    plain and empty, with no tokens; a text that holds a sentinel stays plain. Rows with one doc_id draw alike, and a null doc_id draws as
    an empty one; the draws depend on seed and doc_id alone, so reruns agree. Other columns are not read; an empty table gives an empty table.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            n, forms, prefix, middle, outputs = _transformed(b.column(1), [x.to_numpy() for x in b.columns[2:]], plain_percent, suffix_first_percent)
            made = [pa.array(n, pa.int64()), pa.array(forms, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(outputs, pa.binary()).cast(pa.string(), safe=False)]
            yield pa.RecordBatch.from_arrays([b.column(0), *made], names=names)

    given = docs.select("doc_id", "text", *(x.alias(f"h{k}") for k, x in enumerate(draws(F.col("doc_id"), seed))))
    return given.mapInArrow(tidy(run), f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text from which an output was made. Sentinels occur in it only where they were put, so that it splits at them."""
    parts = F.split(output, "<[PSM]>")
    first, second, middle = (F.element_at(parts, k) for k in (2, 3, 4))
    return F.when(form == "psm", F.concat(first, middle, second)).when(form == "spm", F.concat(second, middle, first)).otherwise(output)
