"""Fill-in-the-middle, vector codes, the quality classifier."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from attest.llm import fill_middle, langid, quality_trees, vector_codes
from attest.llm.common import pieces, span_hashes

from .cases import clashing, documents, empty, prose

TOKEN = re.compile("[A-Za-z]+|[^A-Za-z]")


# --- fill in the middle ---


def filled_by_force(doc_id, text):
    text = text or ""
    tokens = TOKEN.findall(text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(tokens) + 1), h[1] % (len(tokens) + 1)))
    p, m, s = ("".join(x) for x in (tokens[:a], tokens[a:b], tokens[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, len(tokens), "plain", None, None, text
    form = "spm" if h[3] % 100 < 20 else "psm"
    return doc_id, len(tokens), form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


def odd_texts(spark):
    r = random.Random(7)
    bits = ["<P>", "<", "S>", "<S", "é", "𝒳", "ab", "Z", " ", "\n", "<M>", "\0", "-", "́"]
    rows = [(k, "".join(r.choice(bits[1:] if k % 3 else bits) for _ in range(k % 40))) for k in range(400)]
    return spark.createDataFrame([*rows, (400, "a" * 70_000), (401, "é" * 70_000), (402, "x y " * 30_000), (402, "again"), (None, "no id"), (403, None)], "doc_id long, text string")


@pytest.mark.parametrize("shape", [documents, odd_texts, lambda s: clashing(documents(s)), lambda s: odd_texts(s).repartition(13)])
def test_fill_middle_is_brute_force(spark, shape):
    df = shape(spark)
    out = fill_middle.fill_middle(df)
    want = Counter(filled_by_force(r.doc_id, r.text) for r in df.collect())
    assert Counter(map(tuple, out.collect())) == want
    again = out.select("doc_id", fill_middle.restored(F.col("output"), F.col("form")).alias("text"))
    assert Counter(map(tuple, again.collect())) == Counter((r.doc_id, r.text or "") for r in df.collect())


def test_fill_middle_of_nothing(spark):
    assert fill_middle.fill_middle(empty(spark)).count() == 0


def test_shares_of_forms_are_parameters(spark):
    df = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("some text that is cut").alias("text"))
    form = lambda **kw: {r.form for r in fill_middle.fill_middle(df, **kw).select("form").collect()}
    assert form(plain_percent=100) == {"plain"} and form(plain_percent=0, suffix_first_percent=0) == {"psm"} and form(plain_percent=0, suffix_first_percent=100) == {"spm"}


@pytest.mark.parametrize("size", [0, 1, 7, 8, 511, 512, 513, 5000])
@pytest.mark.parametrize("share", [0.0, 0.02, 0.5, 1.0])
def test_rank_and_select(size, share):
    flags = np.random.default_rng(size).random(size) < share
    bits = fill_middle.Bits(np.packbits(flags), size)
    assert len(bits) == flags.sum()
    assert bits.rank(np.arange(size + 1)).tolist() == [0, *np.cumsum(flags).tolist()]
    assert bits.select(np.arange(len(bits) + 2)).tolist() == [*np.flatnonzero(flags).tolist(), size, size]


def test_boundaries_across_chunks(monkeypatch):
    monkeypatch.setattr(fill_middle, "CHUNK", 16)
    texts = ["", "abc" * 20, "é" * 9, "", "tail end of it", ""]
    data, ends = fill_middle._buffers(pa.array(texts))
    bits = fill_middle.boundaries(data, ends[:-1])
    first = bits.rank(ends)
    assert (first[1:] - first[:-1]).tolist() == [len(TOKEN.findall(t)) for t in texts]
    points = fill_middle.code_points(data).rank(ends)
    assert (points[1:] - points[:-1]).tolist() == [len(t) for t in texts]


# --- vector codes ---


def codes_by_force(rows, parts, entries, rounds):
    """(vec_id, vector, label) -> Counter of (vec_id, label, code, error), and the codebooks; whole passes, plain integers."""
    kept = [(i, [math.floor(256 * float(np.float32(x))) for x in v], c) for i, v, c in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    size = next((len(v) for _, v, _ in kept if v and len(v) % parts == 0), 0)
    if not size:
        return Counter((i, c, None, None) for i, _, c in kept), None
    width = size // parts
    fit = [r for r in kept if len(r[1]) == size]
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, v, _ in fit[:entries]] for p in range(parts)]
    away = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    assign = lambda v: [min((away(cut(v, p), e), k) for k, e in enumerate(books[p])) for p in range(parts)]
    for _ in range(rounds):
        won = defaultdict(list)
        for _, v, _ in fit:
            for p, (_, k) in enumerate(assign(v)):
                won[p, k].append(cut(v, p))
        for (p, k), own in won.items():
            books[p][k] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    out = Counter()
    for i, v, c in kept:
        if len(v) == size:
            told = assign(v)
            out[i, c, bytes(k for _, k in told), sum(d for d, _ in told)] += 1
        else:
            out[i, c, None, None] += 1
    return out, books


DDL = "vec_id long, embedding array<float>, label int"


def vectors(seed=3, n=90, size=8):
    r = random.Random(seed)
    some = [[r.gauss(0, 0.4) for _ in range(size)] for _ in range(n)]
    rows = [(1000 - 3 * k, v, k % 4 if k % 5 else None) for k, v in enumerate(some)]
    rows += [(5, some[0], 1)] * 3 + [(7, [0.0] * size, 2), (8, [-0.001] * size, 2)] + [(2000 + k, some[k % 2], 9) for k in range(60)]
    return rows


ODD = [(1, None, 1), (2, [None] * 8, 1), (3, [float("nan")] * 8, 1), (4, [float("inf"), *[0.0] * 7], 2), (0, [0.5] * 3, 4), (-1, [], 4), (None, [0.25] * 8, None), (6, [0.1] * 16, 5)]


@pytest.mark.parametrize(("parts", "entries", "rounds"), [(4, 6, 2), (2, 200, 1), (8, 3, 4), (4, 5, 0)])
def test_vector_codes_are_brute_force(spark, parts, entries, rounds):
    rows = vectors() + ODD
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, DDL).repartition(5)
    df = df.withColumns({"code": F.lit("clash"), "x": F.lit("clash"), "error": F.lit("clash"), "earlier": F.lit(1)})
    coded, books = vector_codes.compress(df, parts, entries, rounds)
    want, entries_ = codes_by_force(rows, parts, entries, rounds)
    got = Counter((r.vec_id, r.label, None if r.code is None else bytes(r.code), r.error) for r in coded.collect())
    assert got == want
    assert books.entries.tolist() == entries_
    assert books.sha256() == hashlib.sha256(",".join(str(x) for p in entries_ for e in p for x in e).encode()).hexdigest()
    errors = defaultdict(lambda: None)
    for (_, c, _, e), n in want.items():
        if e is not None:
            errors[c] = (errors[c] or 0) + n * e
    told = vector_codes.label_errors(coded).collect()
    assert Counter((r.vec_id, r.label, None if r.code is None else bytes(r.code), r.error) for r in told) == want
    assert all(r.label_error == errors[r.label] for r in told)


def test_labels_beyond_the_hot_ones(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "HOT", 3)  # labels with a third of the rows come by broadcast, the others by join
    df = spark.createDataFrame([(k, 0 if k % 2 else k % 7 or None, k) for k in range(200)], "vec_id long, label int, error long")
    want = defaultdict(int)
    for r in df.collect():
        want[r.label] += r.error
    got = vector_codes.label_errors(df).collect()
    assert sorted(r.vec_id for r in got) == list(range(200)) and all(r.label_error == want[r.label] for r in got)


def test_only_parts_that_moved_are_shuffled(spark):
    rows = [(k, [float(k % 3)] * 8, 0) for k in range(300)]
    state = spark.createDataFrame(rows, DDL).selectExpr("vec_id", "label", "transform(embedding, x -> cast(256 * x as int)) x", "cast(null as binary) code").repartition(1)
    books = vector_codes.Codebooks.of([[0] * 8, [256] * 8, [512] * 8], 4)
    one = vector_codes.assigned(state, books)
    first = vector_codes.changes(one, books.entries.shape).collect()
    assert sum(r.change for r in first if r.place == 2) == 4 * 300  # place 2 is the count
    books.add([tuple(r) for r in first])
    assert vector_codes.changes(vector_codes.assigned(one, books), books.entries.shape).count() == 0
    books.entries[0, 0] = 300  # part 0 of the zeros goes elsewhere
    moved = vector_codes.changes(vector_codes.assigned(one, books), books.entries.shape).collect()
    assert {(r.part, r.entry, r.place, r.change) for r in moved} <= {(0, k, j, v) for k in range(3) for j in range(3) for v in (100, -100, 25600, -25600, 51200, -51200)}
    assert sum(r.change for r in moved if r.place == 2) == 0


def test_large_and_wide_vectors_stay_exact():
    r = np.random.default_rng(2)
    for size, most in ((4, 1 << 24), (300, 1 << 24), (300, 100)):
        x, e = r.integers(-most, most, (20, 2, size)), r.integers(-most, most, (2, 7, size))
        code, away = vector_codes.nearest(x, e)
        for k in range(20):
            for p in range(2):
                d = [sum((int(a) - int(b)) ** 2 for a, b in zip(x[k, p], e[p, j], strict=True)) for j in range(7)]
                assert away[k, p] == min(d) and code[k, p] == d.index(min(d))
    good, told = vector_codes.integers(pa.array([[1e30, -1e30], None, [0.5, None]], pa.list_(pa.float32())))
    assert good.tolist() == [True, False, False] and told.to_pylist() == [[1 << 24, -(1 << 24)]]


def test_decoded_vectors_are_near(spark):
    rows = vectors()
    coded, books = vector_codes.compress(spark.createDataFrame(rows, DDL), 8, 64)
    known = {i: v for i, v, _ in rows}
    for r in vector_codes.decoded(coded, books).collect():
        far = sum((a - b) ** 2 for a, b in zip(known[r.vec_id], r.embedding, strict=True))
        assert far <= 2 * (r.error / 65536) + 8 / 65536


@pytest.mark.parametrize("rows", [[], [(1, None, 2)], [(1, [1.0, 2.0, 3.0], None)]])
def test_vector_codes_of_nothing(spark, rows):
    coded, books = vector_codes.compress(spark.createDataFrame(rows, DDL), 4)
    assert books is None and [tuple(r) for r in coded.collect()] == [(1, None, None, None)] * (len(rows) and rows[0][1] is not None)
    assert vector_codes.label_errors(coded).count() == coded.count()


# --- quality classifier ---


def test_pieces_and_span_hashes():
    raw = (prose(4000, 3) + "  " + "w" * 5000 + " " + prose(100, 4)).encode()
    for most, word in ((50, None), (1000, None), (1 << 20, None), (100, 64)):
        cut = list(pieces(raw, most, word))
        assert b"".join(cut) == raw
        if word is None:
            assert [w for p in cut for w in p.split()] == raw.split()
        else:
            assert max(map(len, cut)) <= most + word
    assert list(pieces(b"")) == []
    wide = b"ab " * 60_000 + b"abc " + b"ab" * 40_000 + b" ab"
    data = np.frombuffer(wide, np.uint8)
    words = [(m.start(), m.end()) for m in re.finditer(b"[^ ]+", wide)]
    h = span_hashes(data, np.array([a for a, _ in words]), np.array([b for _, b in words]))
    names = {}
    for (a, b), k in zip(words, h.tolist(), strict=True):
        assert names.setdefault(wide[a:b], k) == k
    assert len(set(names.values())) == len(names) == 3


def statistics_by_force(text):
    """Those statistics that a plain program tells in a line each."""
    words, letters = text.split(), sum(c.isalpha() for c in text)
    kinds = Counter(words)
    n = max(len(words), 1)
    return {
        "words": math.log1p(len(words)), "bytes": math.log1p(len(text.encode())), "kinds": len(kinds) / n, "stutters": sum(a == b for a, b in zip(words, words[1:])) / n,
        "echoes": sum(a == b for a, b in zip(words, words[2:])) / n, "upper": sum("A" <= c <= "Z" for c in text) / max(letters, 1), "shouts": sum(c in "!?" for c in text) / n,
        "commonest": max(kinds.values(), default=0) / n, "short_words": sum(len(w.encode()) <= 2 for w in words) / n, "longest_word": math.log1p(max((len(w.encode()) for w in words), default=0)),
    }


def test_statistics(monkeypatch):
    for text in ("", " \n", "one", "Ha ha ha ha!! No? É è", prose(300, 5), "AND AND AND\n" * 40, "a b a b a b # $ 12,5"):
        told = dict(zip(quality_trees.FEATURES, quality_trees.statistics(text.encode()), strict=True))
        for name, value in statistics_by_force(text).items():
            assert told[name] == pytest.approx(value, abs=1e-6), (text[:20], name)
    lines = "one\n\ntwo \n one\none\n" + "tail" * 9
    for most in (3, 8, 1 << 20):
        monkeypatch.setattr(quality_trees, "pieces", lambda raw, most=most, **kw: pieces(raw, most))
        told = dict(zip(quality_trees.FEATURES, quality_trees.statistics(lines.encode()), strict=True))
        assert (told["lines"], told["again_lines"]) == (pytest.approx(math.log1p(5)), pytest.approx(1 / 5))
    worst = dict(zip(quality_trees.FEATURES, quality_trees.statistics((prose(3000, 6) + " same" * 64).encode()), strict=True))
    assert worst["stutters"] < 0.05 and worst["worst_stutters"] > 0.9 and worst["longest_run"] == pytest.approx(math.log1p(63), abs=0.02)


def test_statistics_do_not_depend_on_pieces(monkeypatch):
    text = (prose(5000, 8) + "\n" + prose(5000, 9)).encode()
    whole = quality_trees.statistics(text)
    monkeypatch.setattr(quality_trees, "pieces", lambda raw, **kw: pieces(raw, 4096))
    cut = quality_trees.statistics(text)
    same = [k for k, name in enumerate(quality_trees.FEATURES) if not name.startswith("worst") and name not in ("stutters", "echoes")]
    assert np.allclose(whole[same], cut[same])  # the rest counts pairs and blocks within a piece
    assert np.allclose(whole, cut, atol=0.15)


def walked(trees, row):
    """One row down each tree, by recursion."""
    total = trees.base
    for f, t, leaf in zip(trees.feature, trees.threshold, trees.leaf, strict=True):
        k = 0
        while k < len(f):
            k = 2 * k + 1 + int(row[f[k]] > t[k])
        total += leaf[k - len(f)]
    return total


def test_trees_walk_and_split_by_brute_force():
    r = np.random.default_rng(4)
    x = np.round(r.normal(size=(400, 5)), 1).astype(np.float32)
    y = ((x[:, 0] > 0.3) ^ (x[:, 3] < -0.2)).astype(float)
    trees = quality_trees.boosted(x, y, np.ones(400), 12, 3)
    margins = trees.margins(x)
    assert np.allclose(margins, [walked(trees, row) for row in x])
    assert ((margins > 0) == y).mean() > 0.97
    stump = quality_trees.boosted(x, y, np.ones(400), 1, 1)
    base, edges = y.mean(), [np.unique(np.quantile(c, np.linspace(0, 1, quality_trees.BINS + 1)[1:-1], method="lower")) for c in x.T]
    p = 1 / (1 + np.exp(-stump.base))
    g, h = p - y, np.full(400, p * (1 - p))
    value = lambda at: g[at].sum() ** 2 / (h[at].sum() + quality_trees.SHRINK)
    every = np.ones(400, bool)
    best = max((value(x[:, f] <= t) + value(x[:, f] > t) - value(every), -f, -t) for f in range(5) for t in edges[f] if min(h[x[:, f] <= t].sum(), h[x[:, f] > t].sum()) >= quality_trees.LEAST)
    assert (stump.feature[0, 0], stump.threshold[0, 0]) == (-best[1], np.float32(-best[2])) and 0 < base < 1
    left = x[:, stump.feature[0, 0]] <= stump.threshold[0, 0]
    assert stump.leaf[0] == pytest.approx([-quality_trees.RATE * g[at].sum() / (h[at].sum() + quality_trees.SHRINK) for at in (left, ~left)])


def test_quality_scores_tell_held_out_labels(spark, sf_dir):
    folder = sf_dir.replace("sf0.001", "sf0.01")
    docs, labels = (spark.read.parquet(f"{folder}/{x}.parquet") for x in ("documents", "labels"))
    held = langid.remainder(F.col("doc_id"), 3) == 1
    rows = quality_trees.quality_scores(docs, labels, held).join(labels, "doc_id").where("held_out").collect()
    ones, zeros = [r.score for r in rows if r.quality == 1], [r.score for r in rows if r.quality == 0]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in ones for b in zeros])
    assert len(zeros) > 10 and auc > 0.97 and np.mean([r.predicted == r.quality for r in rows]) > 0.96
    turned = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = quality_trees.quality_scores(docs.withColumn("lang", F.lit("xx")), turned, held)  # labels held out, and lang, do not matter
    first = {r.doc_id: r.score for r in quality_trees.quality_scores(docs, labels, held).collect()}
    assert {r.doc_id: r.score for r in again.collect()} == first


@pytest.mark.parametrize("shape", [documents, lambda s: clashing(documents(s)), empty])
def test_quality_scores_edges(spark, shape):
    docs = shape(spark)
    held = langid.remainder(F.col("doc_id"), 3) == 1
    n = docs.count()
    for rows in ([], [(1, 1, 0)], [(1, 1, 0), (1, 0, 0), (3, 0, 1), (None, 1, None), (8, None, 0), (9, 7, 0), (10, 1, 1), (77, 1, 0)]):
        labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
        got = quality_trees.quality_scores(docs, labels, held).collect()
        assert len(got) == n and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
        if not rows:
            assert {r.score for r in got} <= {0.5}


def test_the_sample_is_bounded(spark):
    labels = spark.range(5000).select(F.col("id").alias("doc_id"), (F.col("id") % 10 > 0).cast("int").alias("quality"))
    drawn, counts = quality_trees.sample(labels, F.col("doc_id") % 3 == 1, 100)
    assert Counter(r.quality for r in drawn.collect()) == {0: 100, 1: 100}
    assert sum(counts.values()) == 3333 and all(r.doc_id % 3 != 1 for r in drawn.collect())


def test_column_names_with_backticks(spark):
    """Names that must be quoted are handed on; only the quality filter cannot, whose pass over whole rows Spark itself refuses for them."""
    from attest.llm import exact_dedup, mixing, near_dedup

    df = spark.createDataFrame([(1, prose(30, 1), "a", "x"), (2, prose(30, 1), "a", "y"), (3, prose(30, 2), None, None)], ["doc_id", "text", "source", "odd `name`.x"])
    for keep in (exact_dedup.exact_dedup, near_dedup.near_dedup, mixing.mix):
        out = keep(df)
        assert out.columns == df.columns and {tuple(r) for r in out.collect()} <= {tuple(r) for r in df.collect()}
