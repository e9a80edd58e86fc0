"""A quality classifier: gradient-boosted trees over histograms of document statistics.

Statistics come from one pass over each whole text, a piece at a time. Trees are fitted by second-order boosting of the log loss on a
bounded sample of labelled rows (A_CLASS of each class, weighted back to the classes' shares): features are cut into BINS quantile bins,
and a level of a tree is one histogram of gradients over (node, feature, bin). A fitted model is three arrays, complete trees by level, and
scoring walks all trees of a batch of rows at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pieces, slices, span_hashes, tidy

#: The bound of the training sample: labelled documents of each class, drawn by a digest of doc_id.
A_CLASS = 10_000
TREES, DEPTH, RATE, BINS = 80, 4, 0.15, 64
#: Added to the hessian of a leaf, and the least hessian that a side of a split may have.
SHRINK, LEAST = 1.0, 1.0
#: Words of a block: statistics of the worst block tell texts that are junk in one place.
BLOCK = 32

_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digit": b"0123456789",
    "symbol": b"#*$%&|<>=+~^_\\{}[]/@`",
    "stop": b".,;:",
    "shout": b"!?",
    "wide": bytes(k for k in range(256) if k >= 0xC0),  # first bytes of code points beyond ASCII
}
_KIND = np.full(256, len(_CLASSES), np.uint8)
for _k, _bytes in enumerate(_CLASSES.values()):
    _KIND[list(_bytes)] = _k
_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\n\r\x0b\x0c")] = True
_UPPER, _LOWER, _DIGIT, _SYMBOL, _STOP, _SHOUT, _WIDE = range(len(_CLASSES))

#: Statistics of a block of words of which the worst is kept, and what is told of a whole text.
WORST = ("stutters", "few_kinds", "upper", "symbols", "digits", "shouts", "no_letters", "stops")
FEATURES = (
    "words", "bytes", "word_length", "word_spread", "longest_word", "kinds", "stutters", "echoes", "upper", "symbols", "digits", "stops", "shouts", "wide",
    "no_letters", "capitalised", "short_words", "long_words", "lines", "line_length", "again_lines", "commonest", "longest_run", *(f"worst_{x}" for x in WORST),
)


def _longest_run(same: np.ndarray) -> int:
    """The longest run of true."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], same.view(np.int8), [0]])))
    return int((edges[1::2] - edges[::2]).max(initial=0))


def statistics(text: bytes) -> np.ndarray:
    """FEATURES of a whole text in UTF-8. Beyond a piece, only 8 bytes for each distinct word and line are held; of a word of megabytes each piece counts as a word."""
    words = chars = short = long = bare = capital = stutters = echoes = longest = run = lines = 0
    squares = 0.0
    kinds = np.zeros(len(_CLASSES) + 1, np.int64)
    seen, counts = np.empty(0, np.uint64), np.empty(0, np.int64)
    seen_lines: set[int] = set()
    line, told_line = xxhash.xxh64(), False  # the line that goes on in the next piece
    worst = np.zeros(len(WORST))
    for piece in pieces(text, most_word=1 << 20):
        data = np.frombuffer(piece, np.uint8)
        kind = _KIND[data]
        kinds += np.bincount(kind, minlength=len(kinds))
        begun, *others = piece.split(b"\n")
        line.update(begun)
        told_line |= bool(begun.strip())
        if others:
            own_lines = [x for x in others[:-1] if x and not x.isspace()]
            lines += len(own_lines) + told_line
            seen_lines.update(map(xxhash.xxh64_intdigest, own_lines), [line.intdigest()] if told_line else [])
            line, told_line = xxhash.xxh64(others[-1]), bool(others[-1].strip())
        space = np.ones(len(data) + 2, bool)
        space[1:-1] = _SPACE[data]
        edges = np.flatnonzero(space[1:] != space[:-1])
        starts, ends = edges[::2], edges[1::2]
        n = len(starts)
        if not n:
            continue
        h = span_hashes(data, starts, ends)
        size = ends - starts
        words, chars, squares = words + n, chars + int(size.sum()), squares + float((size.astype(np.float64) ** 2).sum())
        short, long, longest = short + int((size <= 2).sum()), long + int((size >= 12).sum()), max(longest, int(size.max()))
        word = np.zeros(len(data) + 1, np.int32)
        word[starts] = 1
        word = np.cumsum(word[:-1], dtype=np.int32) - 1  # white space counts with the word before it; its class is none
        at = np.flatnonzero(kind != _LOWER)
        told = np.bincount(word[at].clip(0) * (len(_CLASSES) + 1) + kind[at], minlength=n * (len(_CLASSES) + 1)).reshape(n, -1).T
        low = np.bincount(word[kind == _LOWER], minlength=n)
        empty = told[_UPPER] + low + told[_WIDE] == 0
        bare, capital = bare + int(empty.sum()), capital + int((kind[starts] == _UPPER).sum())
        same = np.concatenate([[False], h[1:] == h[:-1]])
        stutters, echoes, run = stutters + int(same.sum()), echoes + int((h[2:] == h[:-2]).sum()), max(run, _longest_run(same))
        own, often = np.unique(h, return_counts=True)
        if len(seen):
            own, back = np.unique(np.concatenate([seen, own]), return_inverse=True)
            often = np.bincount(back, np.concatenate([counts, often])).astype(np.int64)
        seen, counts = own, often
        if n >= BLOCK // 2:
            whole = max(n // BLOCK, 1)
            width = min(n, BLOCK)
            cut = lambda x: x[: whole * width].reshape(whole, width)
            block = np.sort(cut(h), 1)
            letters = np.maximum(cut(told[_UPPER] + low + told[_WIDE]).sum(1), 1)
            shares = [
                cut(same).mean(1), 1 - ((block[:, 1:] != block[:, :-1]).sum(1) + 1) / width, cut(told[_UPPER]).sum(1) / letters, cut(told[_SYMBOL]).sum(1) / width,
                cut(told[_DIGIT]).sum(1) / width, cut(told[_SHOUT]).sum(1) / width, cut(empty).mean(1), cut(told[_STOP]).sum(1) / width,
            ]
            worst = np.maximum(worst, [x.max() for x in shares])
    if told_line:
        lines += 1
        seen_lines.add(line.intdigest())
    per, letters = max(words, 1), max(int(kinds[[_UPPER, _LOWER, _WIDE]].sum()), 1)
    mean = chars / per
    out = [
        np.log1p(words), np.log1p(len(text)), mean, np.sqrt(max(squares / per - mean * mean, 0)), np.log1p(longest), len(seen) / per, stutters / per, echoes / per, kinds[_UPPER] / letters,
        kinds[_SYMBOL] / per, kinds[_DIGIT] / per, kinds[_STOP] / per, kinds[_SHOUT] / per, kinds[_WIDE] / letters, bare / per, capital / per, short / per, long / per,
        np.log1p(lines), np.log1p(len(text) / max(lines, 1)), (lines - len(seen_lines)) / max(lines, 1), counts.max(initial=0) / per, np.log1p(run), *worst,
    ]
    return np.array(out, np.float32)


def _features(column: pa.Array) -> np.ndarray:
    texts = column.cast(pa.binary()).to_pylist()
    return np.array([statistics(t or b"") for t in texts], np.float32).reshape(len(texts), len(FEATURES))


@dataclass
class Trees:
    """Complete trees by level: the feature and threshold of each inner node (right if above it) and the value of each leaf; base: log odds without trees."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def margins(self, x: np.ndarray) -> np.ndarray:
        """Log odds of the rows of x: every row goes down every tree, a level at a time."""
        inner = self.feature.shape[1]
        out = np.full(len(x), self.base)
        if not len(self.feature):
            return out
        tree, row = np.arange(len(self.feature)), np.arange(len(x))[:, None]
        node = np.zeros((len(x), len(tree)), np.int64)
        while node[:1, :1].size and node[0, 0] < inner:
            node = 2 * node + 1 + (x[row, self.feature[tree, node]] > self.threshold[tree, node])
        return out + self.leaf[tree, node - inner].sum(1)


def histograms(bins: np.ndarray, node: np.ndarray, nodes: int, width: int, *weights: np.ndarray) -> list[np.ndarray]:
    """Sums of each weight by node, feature and bin."""
    rows, features = bins.shape
    key = ((node * features)[:, None] + np.arange(features)) * width + bins
    return [np.bincount(key.ravel(), np.repeat(w, features), nodes * features * width).reshape(nodes, features, width) for w in weights]


def grow(bins: np.ndarray, edges: list[np.ndarray], g: np.ndarray, h: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One tree for gradients g and hessians h: features, thresholds, leaf values, and the leaf of each row. A node without a gain sends all left."""
    width = max(map(len, edges)) + 1
    node = np.zeros(len(bins), np.int64)
    feature, threshold = np.zeros((1 << depth) - 1, np.int64), np.full((1 << depth) - 1, np.inf, np.float32)
    value = lambda a, b: a * a / (b + SHRINK)
    for level in range(depth):
        nodes = 1 << level
        sums, mass = histograms(bins, node, nodes, width, g, h)
        left, low = sums.cumsum(2), mass.cumsum(2)
        whole, all_ = left[:, :1, -1:], low[:, :1, -1:]
        gain = value(left, low) + value(whole - left, all_ - low) - value(whole, all_)
        gain[(low < LEAST) | (all_ - low < LEAST)] = 0
        best = gain.reshape(nodes, -1).argmax(1)
        f, cut = best // width, best % width
        for k in range(nodes):
            if gain[k, f[k], cut[k]] > 1e-9:
                feature[nodes - 1 + k], threshold[nodes - 1 + k] = f[k], edges[f[k]][cut[k]]
            else:
                cut[k] = width
        node = 2 * node + (bins[np.arange(len(bins)), f[node]] > cut[node])
    leaves = 1 << depth
    return feature, threshold, -RATE * np.bincount(node, g, leaves) / (np.bincount(node, h, leaves) + SHRINK), node


def boosted(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Trees:
    """Trees for rows x with labels y (0 or 1). Without rows of both classes there are no trees, and the base tells the smoothed shares."""
    ones, all_ = float((weight * y).sum()), float(weight.sum())
    base = float(np.log((ones + 1) / (all_ - ones + 1)))
    inner = (1 << depth) - 1
    if len(np.unique(y)) < 2:
        return Trees(base, np.zeros((0, inner), np.int64), np.zeros((0, inner), np.float32), np.zeros((0, inner + 1)))
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for c in x.T]
    bins = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)], 1)
    margin = np.full(len(x), base)
    grown = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        *tree, node = grow(bins, edges, weight * (p - y), weight * p * (1 - p), depth)
        margin += tree[2][node]
        grown.append(tree)
    return Trees(base, *(np.stack(a) for a in zip(*grown, strict=True)))


def sample(labels: DataFrame, held_out: Column, a_class: int = A_CLASS) -> tuple[DataFrame, dict[int, int]]:
    """doc_id and quality of at most a_class documents of each class outside held_out, by a digest of doc_id, and how many each class has.

    Labels other than 0 and 1 are not read; of several labels of one document the majority counts (a tie: 0).
    """
    known = labels.where(~held_out & F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col("quality").cast("int").alias("quality"))
    known = known.groupBy("doc_id").agg((F.avg("quality") > 0.5).cast("int").alias("quality"))
    counts = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    order = (F.xxhash64("doc_id", F.lit("trees")), F.col("doc_id"))
    parts = [known.where(F.col("quality") == k).orderBy(*order).limit(a_class) for k in (0, 1)]
    return parts[0].unionByName(parts[1]), counts


def fit(docs: DataFrame, labels: DataFrame, held_out: Column, a_class: int = A_CLASS) -> Trees:
    """Trees from a bounded sample of the labelled documents outside held_out. Of repeated doc_ids one text is learnt from, the one whose statistics sort last."""
    drawn, counts = sample(labels, held_out, a_class)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            rows = _features(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(rows.tolist(), pa.list_(pa.float32()))], names=["doc_id", "quality", "x"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").select("doc_id", "text", "quality")  # at most 2 * a_class ids
    rows = found.mapInArrow(tidy(run), f"doc_id {kind}, quality int, x array<float>").groupBy("doc_id").agg(F.max(F.struct("x", "quality")).alias("one"))
    told = sorted((r["doc_id"], r["quality"], r["x"]) for r in rows.select("doc_id", "one.quality", "one.x").collect())
    y = np.array([q for _, q, _ in told], np.float64)
    weight = np.array([max(counts[q] / a_class, 1.0) for _, q, _ in told])
    return boosted(np.array([x for *_, x in told], np.float32).reshape(len(told), len(FEATURES)), y, weight)


def scored(docs: DataFrame, trees: Trees) -> DataFrame:
    """doc_id and score of every row; the text alone is read."""
    held = docs.sparkSession.sparkContext.broadcast(trees)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(1 / (1 + np.exp(-held.value.margins(_features(b.column(1))))))], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), f"doc_id {kind}, score double")


def quality_scores(docs: DataFrame, labels: DataFrame, held_out: Column, a_class: int = A_CLASS) -> DataFrame:
    """doc_id, held_out, score (probability of label 1) and predicted (1 from 0.5 on), one row for each row of docs.

    held_out is told from doc_id. Learns from labels (doc_id, quality) of documents outside it; a score reads the text alone. A null text is
    scored as an empty one. Rows repeat as given and a null doc_id stays (it has no label); without labels of both classes every score is
    the smoothed share of label 1, and 0.5 without any. Other columns of either table are not read; an empty table gives an empty table.
    """
    out = scored(docs, fit(docs, labels, held_out, a_class))
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
