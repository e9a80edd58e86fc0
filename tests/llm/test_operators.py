import hashlib
import math
import os
import re
import subprocess
import sys
import time
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from attest.llm import common, exact_dedup, langid, licenses, lm_scoring, mixing, near_dedup, packing, pii, quality, substrings
from attest.llm.graph import components

from .cases import WORDS, clashing, documents, empty, prose, texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPACE = re.compile(r"[\x20\x09-\x0D]+")


def by_text(df):
    return [r.asDict() for r in df.collect()]


# --- exact dedup ---


@pytest.mark.parametrize("shape", [documents, lambda s: clashing(documents(s))])
def test_exact_dedup_is_brute_force(spark, shape):
    df = shape(spark)
    groups = defaultdict(list)
    for i, t in texts(df):
        groups[SPACE.sub(" ", t)].append(i)
    want = Counter()
    for t, ids in groups.items():
        least = min((i for i in ids if i is not None), default=None)
        for i in ids:
            want[i, least, len(ids), i == least, hashlib.sha256(t.encode()).hexdigest()] += 1
    got = Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.marked(df).collect())
    assert got == want
    df = df.withColumns({"_keep": F.lit("x"), "_digest_": F.lit("y")})
    kept = exact_dedup.exact_dedup(df)
    assert kept.columns == df.columns
    assert kept.count() == sum(n for k, n in want.items() if k[3])
    assert Counter(map(tuple, kept.collect())) <= Counter(map(tuple, df.collect()))


def test_exact_dedup_never_merges_what_only_shares_a_digest(spark):
    df = spark.createDataFrame([(1, "one"), (2, "two")], "doc_id long, text string")
    with pytest.raises(Exception, match="share a digest"):
        exact_dedup.classes(df, place=lambda text: F.lit("same")).collect()


def test_exact_dedup_empty(spark):
    assert exact_dedup.marked(empty(spark)).count() == 0


# --- near dedup ---


def components_by_force(rows, k, percent=80):
    sets = []
    for i, t in rows:
        w = t.encode().lower().split()
        sets.append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def root(a):
        while up[a] != a:
            a = up[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]) and (sets[a] == sets[b] or None not in (rows[a][0], rows[b][0])):
                up[root(a)] = root(b)
    least = defaultdict(list)
    for a in range(len(rows)):
        if rows[a][0] is not None:
            least[root(a)].append(rows[a][0])
    return [(i, len(s), min(least[root(a)], default=None) if s else i) for a, ((i, _), s) in enumerate(zip(rows, sets, strict=True))]


def test_near_duplicates_are_brute_force(spark):
    df = clashing(documents(spark))
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(df, shingle=2).collect())
    assert got == Counter(components_by_force(texts(df), 2))


def test_texts_that_share_a_doc_id_are_judged_each_by_itself(spark):
    a, b, c = prose(60, 1), prose(60, 2), prose(60, 3)
    rows = [(1, a), (5, a), (5, b), (5, b), (7, b), (7, c), (None, c), (None, prose(50, 4)), (9, None), (9, "")]
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string")).withColumns({"_gone": F.lit("x"), "_gone_text": F.lit("y"), "text_hash": F.lit("z")})
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(df, shingle=2).collect())
    assert got == Counter(components_by_force([(i, t or "") for i, t in rows], 2))
    kept = near_dedup.near_dedup(df, shingle=2)
    assert kept.columns == df.columns
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter([(1, a), (5, b), (5, b), (7, c), (None, rows[7][1]), (9, None), (9, "")])
    assert {tuple(r)[2:] for r in kept.collect()} == {tuple(r)[2:] for r in df.collect()}


def test_whole_groups():
    keys = sorted([(a, b, 0) for a in range(4) for b in range(a + 1) for _ in range(1 + 7 * (a == b))])
    for size in (1, 2, 5, 100):
        batches = [pa.RecordBatch.from_arrays([pa.array([k[j] for k in keys[at : at + size]]) for j in range(3)], names=list("kij")) for at in range(0, len(keys), size)]
        found = [list(zip(*(t.column(j).to_pylist() for j in range(3)), strict=True)) for t in near_dedup.whole_groups(iter(batches))]
        assert sum(found, []) == keys
        assert len({k for t in found for k in set(t)}) == sum(len(set(t)) for t in found)


@pytest.mark.parametrize("rounds", [0, 4])
def test_chains_and_big_groups_of_near_copies(spark, monkeypatch, rounds):
    monkeypatch.setattr(near_dedup, "BLOCK", 3)  # so that buckets have several blocks
    monkeypatch.setattr(near_dedup, "PIVOT_ROUNDS", rounds)
    rows = []
    for g in range(4):
        words = prose(80, 100 + g).split()
        for n in range(30):  # each differs a little from the one before: a chain whose ends are far apart
            words = [*words]
            words[(7 * n) % 80] = f"w{n}"
            rows.append((1000 * g + n, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(df, shingle=2).collect())
    assert got == Counter(components_by_force(rows, 2))
    assert near_dedup.near_dedup(df, shingle=2).count() == sum(1 for i, _, c in components_by_force(rows, 2) if i == c)


def test_near_duplicates_empty(spark):
    assert near_dedup.near_duplicates(empty(spark)).count() == 0
    none = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert {(r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicates(none).collect()} == {(1, 1, True), (2, 2, True)}


def test_bayesian_bounds_keep_true_pairs():
    least = near_dedup.least_matches()
    assert least == sorted(least) and least[-1] < 0.8 * near_dedup.HASHES
    rng = np.random.RandomState(1)
    a = rng.randint(0, 1 << 30, (2000, near_dedup.HASHES)).astype(np.uint32)
    b = np.where(rng.rand(*a.shape) < 0.8, a, a + 1)
    far = np.where(rng.rand(*a.shape) < 0.4, a, a + 1)
    assert near_dedup.may_be_similar(a, b, least).all()
    assert not near_dedup.may_be_similar(a, far, least).any()


def test_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(1, 60)] + [(100, 99), (99, 100), (7, 7), (200, 150), (150, 170)], "a long, b long")
    got = {r.id: r.component for r in components(edges).collect()}
    assert got == {k: 1 for k in range(2, 61)} | {100: 99, 200: 150, 170: 150}


# --- language id ---


def test_language_id(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = langid.language_id(df, langid.remainder(F.col("doc_id"), 4) == 2).join(df.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    assert sum(r.lang_pred == r.lang for r in held) >= 0.97 * len(held)


def test_language_id_edges(spark):
    df = clashing(documents(spark))
    got = langid.language_id(df, F.lit(False)).collect()
    assert len(got) == df.count()
    und = {r.doc_id for r in got if r.lang_pred == "und"}
    assert und == {4, 5, 6}
    assert {r.lang_pred for r in langid.language_id(df, F.lit(True)).collect()} == {"und"}
    assert langid.language_id(empty(spark), F.lit(False)).count() == 0


def naive_bayes_by_hand(rows):
    """Multinomial naive Bayes over hashed n-grams, gram by gram: text -> (language, posterior probability)."""

    def bucket(gram):
        h = 0x9E3779B1 * len(gram) & 0xFFFFFFFF
        for c in gram:
            h = (h ^ ord(c)) * 0x85EBCA6B & 0xFFFFFFFF
            h ^= h >> 15
        return h & langid.BUCKETS - 1

    def grams(text):
        low = text.lower()
        for n in langid.ORDERS:  # those that reach over the end are filled up with zeros
            yield from ((n, bucket((low + "\0\0")[k : k + n])) for k in range(len(low)))

    counts, docs = defaultdict(Counter), Counter()
    for text, lang in rows:
        docs[lang] += 1
        counts[lang].update(grams(text))
    totals = {(x, n): sum(c for (m, _), c in counts[x].items() if m == n) + 0.1 * langid.BUCKETS for x in docs for n in langid.ORDERS}

    def told(text):
        if not any(c.isalpha() for c in text) or not docs:
            return "und", 0.0
        joint = {x: math.log(docs[x] / sum(docs.values())) + sum(math.log((counts[x][g] + 0.1) / totals[x, g[0]]) for g in grams(text)) for x in sorted(docs)}
        best = max(joint, key=joint.get)
        return best, 1 / sum(math.exp(j - joint[best]) for j in joint.values())

    return told


@pytest.mark.parametrize("a_pass", [64, 2])
def test_language_id_is_brute_force(spark, sf_dir, a_pass):
    some = spark.read.parquet(f"{sf_dir}/documents.parquet").where("n_chars < 1500").orderBy("doc_id").limit(60).select("doc_id", "text", "lang", "source")
    df = clashing(documents(spark).select(F.col("doc_id") + 100_000, F.substring("text", 1, 3000), "lang", "source").toDF(*some.columns).unionByName(some))
    odd = ["½ ²", "① Ⅷ 12", "\u0301\u0300", "ª", "3 ʰ", "_ ٣", "²½x"]
    df = df.unionByName(spark.createDataFrame([(200_000 + k, t, None, None) for k, t in enumerate(odd)], "doc_id long, text string, lang string, source string"), allowMissingColumns=True)
    rows = [(r.doc_id, r.text, r.lang) for r in df.collect()]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 4 == 2
    told = naive_bayes_by_hand([(t, x) for i, t, x in rows if t is not None and x is not None and not held(i)])
    want = sorted(((i is None, i or 0), held(i), *told(t or "")) for i, t, _ in rows)
    got = sorted(((r.doc_id is None, r.doc_id or 0), r.held_out, r.lang_pred, r.score) for r in langid.language_id(df, langid.remainder(F.col("doc_id"), 4) == 2, a_pass=a_pass).collect())
    assert [x[:3] for x in got] == [x[:3] for x in want]
    assert [x[3] for x in got] == pytest.approx([x[3] for x in want], abs=1e-3)


def test_languages_beyond_one_pass(spark):
    """Nine hundred languages of one word each."""
    spell = lambda k: "".join(chr(97 + int(c)) for c in f"{k * 7919 % 100_000:05d}")
    rows = [(k, " ".join([spell(k % 900)] * 3), f"l{k % 900:03d}") for k in range(1800)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.language_id(df, F.col("doc_id") >= 900, a_pass=400).collect()
    assert sum(r.lang_pred == f"l{r.doc_id % 900:03d}" for r in got) >= 0.95 * len(got)


def test_language_scores_do_not_depend_on_the_batch(spark):
    df = documents(spark)
    model = langid.fit(df, langid.language_counts(df))
    some = [t for _, t in texts(df) if t.strip()]
    together = model.scores(some)
    alone = np.concatenate([model.scores([t]) for t in some])
    assert np.allclose(together, alone)


# --- packing ---

P = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.path("byte_bpe_50k.json"))


def check_packing(rows, docs, tokenizer, most_padding):
    streams = Counter()
    tokens = 0
    for i, t in docs:
        ids = tokenizer.encode(t, add_special_tokens=False).ids + [1]
        tokens += len(ids)
        streams[i, len(ids)] += 1
    pieces, sequences, seen = defaultdict(list), defaultdict(list), Counter()
    ids_of = {(i, n): tokenizer.encode(t, add_special_tokens=False).ids + [1] for i, t in docs for n in [len(tokenizer.encode(t, add_special_tokens=False).ids) + 1]}
    for r in rows:
        sequences[r.sequence_id].append(r)
        seen[r.doc_id, r.doc_tokens] += r.length
        own = ids_of[r.doc_id, r.doc_tokens][r.start : r.start + r.length]
        pieces[r.doc_id, r.doc_tokens].append(r.start)
        assert len(own) == r.length and zlib.crc32(np.array(own, "<u4").tobytes()) == r.ids_crc32
    assert seen == Counter({k: k[1] * n for k, n in streams.items()})
    padding = 0
    assert sorted(sequences) == list(range(len(sequences)))
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
        padding += 2048 - at if at & (at - 1) else 0
    assert padding <= most_padding * tokens


def test_packing(spark, sf_dir, tokenizer):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    check_packing(packing.pack(df, P.path("byte_bpe_50k.json"), P.PATTERN, rows_a_rank_task=50).collect(), texts(df), tokenizer, 0.02)


def test_packing_edges(spark, tokenizer):
    df = clashing(documents(spark))
    check_packing(packing.pack(df, P.path("byte_bpe_50k.json"), P.PATTERN).collect(), texts(df), tokenizer, 0.1)
    assert packing.pack(empty(spark), P.path("byte_bpe_50k.json"), P.PATTERN).count() == 0


def test_chunked_encoding_is_that_of_the_whole_text(tokenizer):
    e = packing.Encoder(P.path("byte_bpe_50k.json"), P.PATTERN, most=5)
    for t in ["", " ", "a b", " lead", "trail ", "two  gaps", "a\n b", "a \nb", "tab\t b", "é ü x   y", "it's don't", "1 2 33", "a\x1c b\x1d c", "<|endoftext|> x", "a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>  y <|endoftext|", " <|endoftext|>\n", "two  <|endoftext|>  gaps", "…  —", "\n\n\n", "x 　y"]:
        assert np.frombuffer(e.encode(t), "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


def test_plan_uses_every_piece_once():
    rng = np.random.RandomState(3)
    for most in (1, 5, 3000):
        histogram = {int(x): int(rng.randint(1, most + 1)) for x in [*range(1, 64, 5), *range(64, 2049, 192)]}
        used = Counter()
        patterns = packing.plan(histogram)
        for pattern, n in patterns:
            assert n > 0 and sum(x * k for x, k in pattern.items()) <= 2048
            for x, k in pattern.items():
                used[x] += n * k
        assert used == Counter(histogram)
        total = sum(x * n for x, n in histogram.items())
        assert sum(n for _, n in patterns) <= math.ceil(total / 2048) * 1.02 + 2


# --- substring dedup ---


def without_repeats(rows, n=13):
    first, out = {}, Counter()
    for i, t in sorted((r for r in set(rows) if r[0] is not None)):
        w = t.encode().split()
        for k in range(len(w) - n + 1):
            first.setdefault(tuple(w[k : k + n]), i)
    for i, t in rows:
        w = t.encode().split()
        gone = set()
        for k in range(len(w) - n + 1):
            if i is not None and first[tuple(w[k : k + n])] < i:
                gone.update(range(k, k + n))
        out[i, len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()] += 1
    return out


@pytest.mark.parametrize("hot", [substrings.HOT, (0, 1, 2)])
def test_substring_dedup_is_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(substrings, "HOT", hot)
    df = clashing(documents(spark))
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substrings.substring_dedup(df).collect())
    assert got == without_repeats(texts(df))


def test_texts_that_share_a_doc_id_lose_their_own_repeats(spark):
    a, b = prose(60, 1), prose(9, 2)
    rows = [(1, a), (5, a + " " + b), (5, b + " " + a), (5, b), (7, b + " " + prose(40, 3)), (None, a), (9, None), (9, "a b c " * 500), (10, "a b c " * 300), (11, "c a b " * 300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substrings.substring_dedup(df).collect())
    assert got == without_repeats([(i, t or "") for i, t in rows])


def test_without_a_filter_the_anchors_are_joined(spark, monkeypatch):
    monkeypatch.setattr(substrings, "BLOOM_BITS", 0)
    df = documents(spark)
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substrings.substring_dedup(df).collect())
    assert got == without_repeats(texts(df))


def test_maximal_repeats(spark):
    a, b = prose(30, 1), prose(20, 2)
    x, y, z = prose(5, 3), prose(7, 4), prose(12, 5)
    rows = [(1, a), (2, b), (3, f"{x} {a} {y} {b} {z}"), (4, f"{z} {y}"), (5, f"{a} {b} {a}")]
    found = substrings.repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {(r.doc_id, r.start, r.n_words) for r in substrings.maximal_repeats(found).collect()}
    assert got == {(3, 5, 30), (3, 42, 20), (5, 0, 80)}


def test_bloom_filters_lose_nothing(spark):
    from attest.llm.common import bloom, in_bloom

    values = np.random.RandomState(1).randint(-(1 << 62), 1 << 62, 5000)
    df = spark.createDataFrame([(int(x),) for x in values], "x long")
    bits = bloom(df, "x", len(values))
    assert in_bloom(bits, values.view(np.uint64)).all()
    assert in_bloom(bits, np.arange(20_000, dtype=np.uint64)).mean() < 0.05
    assert not in_bloom(bloom(df.where("false"), "x", 0), values.view(np.uint64)).any()


def test_hot_passages(spark):
    shared = prose(60, 9)
    rows = [(k, prose(20 + k % 7, k) + " " + shared + " " + prose(15, 1000 + k)) for k in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = substrings.substring_dedup(df, with_text=True).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == without_repeats(rows)
    assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in got)


def test_substring_dedup_empty(spark):
    assert substrings.substring_dedup(empty(spark)).count() == 0


# --- mixing ---


def targets_by_force(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    total, held = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in held)
        w = sum(weight[s] for s in names if s not in held)
        over = {s for s in names if s not in held and left * weight[s] / w > 3 * sizes[s]}
        if not over:
            return {s: float(3 * sizes[s]) if s in held else left * weight[s] / w for s in names}
        held |= over


@pytest.mark.parametrize("ranges,levels", [(1, 1), (16, 2), (mixing.RANGES, mixing.LEVELS)])
def test_mixing(spark, sf_dir, ranges, levels):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = mixing.mixed(df, keep=("doc_id", "source"), ranges=ranges, levels=levels).collect()
    sizes, taken, target, longest = Counter(), Counter(), {}, Counter()
    for r in rows:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        longest[r.source] = max(longest[r.source], r.size)
        assert r.taken <= 3 * r.size and (not r.size or r.taken % r.size == 0)
    want = targets_by_force(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(want[s])
        assert abs(taken[s] - target[s]) <= longest[s]
    again = Counter((r.doc_id, r.taken) for r in mixing.mixed(df.repartition(5), ranges=ranges, levels=levels).collect())
    assert again == Counter((r.doc_id, r.taken) for r in rows)


def inclusions_by_force(sizes, lack):
    """Inclusion of each of some documents, in proportion to size but for those that are certain, so that the words expected are those that lack."""
    if lack <= 0:
        return [0.0] * len(sizes)
    certain = set()
    while True:
        rest = [k for k in range(len(sizes)) if k not in certain]
        left = lack - sum(sizes[k] for k in certain)
        t = sum(sizes[k] ** 2 for k in rest) / left if left > 0 else math.inf
        more = {k for k in rest if sizes[k] >= t}
        if not more:
            return [1.0 if k in certain else sizes[k] / t for k in range(len(sizes))]
        certain |= more


def ranks_by_force(rows, lack, seed=0):
    """(id, text, size) -> (rank, size) and inclusion, of the documents of one source."""
    out = []
    for (i, text, size), p in zip(rows, inclusions_by_force([r[2] for r in rows], lack), strict=True):
        said = hashlib.md5(text.encode()).hexdigest() if i is None else i
        u = (int(hashlib.md5(f"{seed}:{said}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        out.append(((0.0 if p >= 1 else u / (1 - u) * ((1 - p) / p) if p else math.inf, size), p))
    return out


def test_mixing_is_pareto_sampling(spark, sf_dir):
    """Ranked by hand: random odds over inclusion odds that differ within a source, and certain documents."""
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    long = spark.createDataFrame([(10_000 + k, "w " * n, source) for k, (n, source) in enumerate([(5000, "new"), (900, "new"), *[(10 + j, "new") for j in range(40)], (3000, "src1")])], "doc_id long, text string, source string")
    df = df.select("doc_id", "text", "source").unionByName(long)
    got = {r.doc_id: r for r in mixing.mixed(df, keep=("doc_id", "source")).collect()}
    by = defaultdict(list)
    for r in got.values():
        if r.size:
            by[r.source].append(r)
    differ, certain = 0, 0
    for source, rows in by.items():
        sure = int(rows[0].target // rows[0].source_size)
        lack = rows[0].target - sure * rows[0].source_size
        told = ranks_by_force([(r.doc_id, "", r.size) for r in rows], lack)
        for r, (_, p) in zip(rows, told, strict=True):
            assert r.inclusion == pytest.approx(p)
            certain += r.inclusion == 1
        assert sum(r.size * r.inclusion for r in rows) == pytest.approx(max(lack, 0), abs=1e-6)
        ranked = sorted((key, r.doc_id) for r, (key, _) in zip(rows, told, strict=True))
        taken, words = set(), 0
        for _, i in ranked:
            if lack - words >= got[i].size / 2 and lack > 0:
                taken.add(i)
            words += got[i].size
        differ += [i for _, i in ranked] != sorted(i for _, i in ranked)
        assert {r.doc_id for r in rows if r.taken > sure * r.size} == taken, source
        assert {r.doc_id for r in rows if r.inclusion == 1} <= taken
    assert differ and certain


def test_many_sources_are_placed_in_ranges(spark):
    """Sources by the thousand: placed in ranges of their order, with the sums before them."""
    r = np.random.RandomState(3)
    sizes = {f"s{k:05d}": int(r.randint(0, 50)) for k in range(3000)} | {None: 17, "é": 400_000, "\U00010000": 3}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long").repartition(7)
    want = targets_by_force(sizes)
    assert {x.source: x.target for x in mixing.targets(df).collect()} == pytest.approx(want)
    told = mixing.placed(df, [F.col("source_size"), F.col("source")], {"before": "source_size"}, "place").collect()
    words = 0
    for k, x in enumerate(sorted(told, key=lambda x: (x.source_size, x.source is not None, (x.source or "").encode())), 1):
        assert (x.place, x.before) == (k, words)
        words += x.source_size


def test_rows_without_a_doc_id_draw_by_their_text(spark):
    df = spark.createDataFrame([(None, f"some words of text {k} " * 3, "a") for k in range(60)] + [(1, "big " * 900, "b")], "doc_id long, text string, source string")
    u = {r.u for r in df.where("doc_id is null").select(mixing.uniform(F.col("doc_id"), 0, F.col("text")).alias("u")).collect()}
    assert len(u) == 60


def test_ranges_do_not_change_the_sample(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    one, many = (Counter((r.doc_id, r.taken) for r in mixing.mixed(df, ranges=b, levels=k).collect()) for b, k in ((1, 1), (64, 4)))
    assert one == many


def test_mixing_edges(spark):
    df = clashing(documents(spark))
    rows = mixing.mixed(df).collect()
    assert Counter((r.doc_id, r.size) for r in rows) == Counter((i, len(WORD.findall(t))) for i, t in texts(df))
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns
    assert mixed.count() == sum(r.taken // r.size for r in rows if r.size)
    assert set(map(tuple, mixed.collect())) <= set(map(tuple, df.collect()))
    assert mixing.mixed(empty(spark)).count() == 0
    blank = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert {(r.doc_id, r.target, r.taken) for r in mixing.mixed(blank).collect()} == {(1, 0.0, 0), (2, 0.0, 0)}


# --- licences ---


def license_words(text):
    return re.findall(r"[^\W_]+", text.lower())


def licenses_by_hand(rows, templates, t=0.8):
    pairs = lambda text: list(zip(license_words(text), license_words(text)[1:], strict=False))
    found = defaultdict(list)
    for doc, text in rows:
        g, hits = pairs(text or ""), []
        for k, (_, notice) in enumerate(templates):
            seq = pairs(notice)
            votes = Counter(max(0, at - seq.index(x)) for at, x in enumerate(g) if x in seq)
            for s, n in votes.items():
                a, b = set(g[s : s + len(seq)]), set(seq)
                dice = 2 * len(a & b) / (len(a) + len(b))
                if n >= math.ceil(len(b) / 20) and dice >= t:
                    hits.append((dice, len(seq), -k, -s))
        for x in hits:
            if not any(y > x and -x[3] < -y[3] + y[1] and -y[3] < -x[3] + x[1] for y in hits):
                found[doc, templates[-x[2]][0]].append(x[0])
    return {key: (max(v), len(v)) for key, v in found.items()}


def scanned(df, **how):
    return {(r.doc_id, r.license_id): (r.dice, r.n_matches) for r in licenses.license_scan(df, **how).collect()}


def license_texts():
    import textwrap

    full = {name: text for name, text in licenses.TEMPLATES if "\n" in text}
    r = np.random.RandomState(6)
    rows = [
        (1, "Some prose.\nThis work is licensed under the GNU General Public License, version 3.\nMore."),
        (2, "all RIGHTS reserved\nAll rights reserved."),
        (3, "Licensed under CC BY-NC 4.0."),
        (4, "Licensed under CC BY 4.0."),
        (5, "We licensed the work to the public. The rights of the reserved public are broad."),
        (6, None),
        (7, ""),
        (None, "Released under the MIT License!"),
        (8, "Licensed under the Apache License, Version 2.0.\nReleased under the MIT License."),
        (9, "y" * 100_000 + " " + "word " * 20_000),
        (10, "Copyright (c) 2021 Acme. All rights reserved. And so on."),
        (11, "All rights reserved. " * 70),
        (12, "rights"),
    ]
    for k, (name, text) in enumerate(full.items()):
        one = " ".join(text.split())
        words = one.split()
        edited = [w if r.rand() > 0.03 else "changed" for w in words]
        halved = [w if r.rand() > 0.35 else "changed" for w in words]
        rows += [
            (100 + k, one),
            (200 + k, "#!/bin/sh\n" + "".join(f"# {x}\n" for x in textwrap.wrap(one, 60)) + prose(50, k)),
            (300 + k, prose(40, k) + " " + " ".join(edited) + " " + prose(30, k)),
            (400 + k, " ".join(halved)),
            (500 + k, f"{prose(20, k)} {one} {prose(300, k)} {one}"),
        ]
    return rows, list(full)


def test_license_scan_is_brute_force(spark):
    rows, _ = license_texts()
    rows += [rows[0], rows[0]]
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    want = licenses_by_hand(rows, licenses.TEMPLATES)
    got = scanned(df)
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in want)
    assert scanned(df.where("false")) == {} and scanned(df, templates=()) == {}


def test_overlapping_licenses_are_brute_force(spark):
    """Templates that overlap, repeat, hold one another and tie."""
    templates = (("A", "one two three"), ("B", "two three four"), ("C", "one two three four five"), ("D", "one two three"), ("E", "four five six one two"))
    r = np.random.RandomState(9)
    rows = [(k, " ".join(r.choice(["one", "two", "three", "four", "five", "six", "x"], 60, p=[0.2, 0.2, 0.2, 0.15, 0.1, 0.1, 0.05]))) for k in range(60)]
    rows += [(100, "one two three four five six " * 30), (101, "one two three " * 50), (102, "two three four " * 9), (103, "one two three four five " * 7 + "one")]
    got = scanned(spark.createDataFrame(rows, "doc_id long, text string"), templates=templates)
    want = licenses_by_hand(rows, templates)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_votes_find_what_all_windows_hold(spark):
    """Templates with words left out, put in and changed: where any window at all reaches the threshold, the scan finds the licence."""
    r = np.random.RandomState(11)
    rows, want = [], []
    for k, (name, notice) in enumerate(licenses.TEMPLATES):
        base = license_words(notice)
        for rate in (0.03, 0.08) if len(base) < 300 else (0.06,):
            said = []
            for w in base:
                u = r.rand()
                said += [] if u < rate / 3 else [r.choice(WORDS)] if u < 2 * rate / 3 else [w, r.choice(WORDS)] if u < rate else [w]
            words = [*r.choice(WORDS, 15), *said, *r.choice(WORDS, 15)]
            g, seq = list(zip(words, words[1:], strict=False)), list(zip(base, base[1:], strict=False))
            b = set(seq)
            if any(2 * len(b & (a := set(g[s : s + len(seq)]))) >= 0.8 * (len(a) + len(b)) for s in range(len(g))):
                want.append((1000 * k + int(100 * rate), k))
                rows.append((1000 * k + int(100 * rate), " ".join(words)))
    got = defaultdict(set)
    for i, name in scanned(spark.createDataFrame(rows, "doc_id long, text string")):
        got[i].add(name)
    found = sum(licenses.TEMPLATES[k][0] in got[i] for i, k in want)
    assert len(want) > 50 and found >= 0.97 * len(want)  # a better match of a like notice of another licence may stand in its place


def test_a_notice_repeated_very_often(spark):
    df = spark.createDataFrame([(1, "All rights reserved. " * 100_000), (2, "Licensed under CC BY 4.0. " * 40_000)], "doc_id long, text string")
    scanned(df.where("false"))
    begun = time.perf_counter()
    assert scanned(df) == {(1, "Proprietary"): (1.0, 100_000), (2, "CC-BY-4.0"): (1.0, 40_000)}
    assert time.perf_counter() - begun < 20  # 10 s on a machine that does nothing else; before, it grew with the square


def test_licenses_are_found_however_they_are_wrapped(spark):
    rows, names = license_texts()
    got = scanned(spark.createDataFrame(rows, "doc_id long, text string"))
    for k, name in enumerate(names):
        assert got[100 + k, name] == (1.0, 1) and got[200 + k, name][0] > 0.95 and got[300 + k, name][0] > 0.8 and got[500 + k, name] == (1.0, 2)
        assert not any(i in (100 + k, 200 + k) and x != name for i, x in got)
        assert (400 + k, name) not in got
    assert (got[1, "GPL-3.0"], got[2, "Proprietary"], got[3, "CC-BY-NC-4.0"], got[4, "CC-BY-4.0"]) == ((1.0, 1), (1.0, 2), (1.0, 1), (1.0, 1))
    assert got[None, "MIT"] == got[8, "Apache-2.0"] == got[8, "MIT"] == got[10, "Proprietary"] == (1.0, 1)
    assert not any(i in (5, 6, 7, 9, 12) for i, _ in got)


# --- personal data ---

PATTERNS = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 12 <= len(re.sub("[^0-9]", "", s)) <= 19 and pii.luhn(re.sub("[^0-9]", "", s))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(re.sub("[^0-9]", "", s)) <= 15),
}


def base_spans(text):
    return sorted((m.start(), k, m.end()) for k, (p, ok) in enumerate(PATTERNS.values()) for m in re.finditer(p, text) if ok(m[0]))


def test_pii_base_is_the_plain_patterns(spark, sf_dir):
    r = np.random.RandomState(5)
    made = ["".join(r.choice(list("ab@.-+_% 0123456789()é\n"), p=None, size=60)) for _ in range(3000)]
    made += ["a@b.c@d.e", "x@y", "x@y.z.", "@@a@b.cc", "1.2.3.4.5.6.7.8", "999.1.1.1", "+1 (555) 123-4567.", "4111 1111 1111 1111", "0000000000000000000000", "+12--.3", "a.b@c-d.e-f.g@h.i"]
    spark_rows = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string").unionByName(spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id") + 100_000, "text").toDF("doc_id", "text"))
    want = {i: base_spans(t) for i, t in texts(spark_rows)}
    for row in pii.find_pii(spark_rows).collect():
        spans = want[row.doc_id]
        said = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in spans)
        assert row.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [sum(k == j for _, k, _ in spans) for j in range(4)]


def iban_by_hand(text):
    """(start, end) of account numbers, tried character by character: groups of four as many as fit, then up to three more."""
    plain = lambda c: c.isascii() and c.isalnum()
    free = lambda k: k < 0 or k >= len(text) or not plain(text[k])
    run = lambda at, n: at + n <= len(text) and all(plain(c) and not c.islower() for c in text[at : at + n])

    def end(at, groups):
        steps = [at + 1, at] if text[at : at + 1] == " " else [at]
        if groups < 7:
            for k in steps:
                if run(k, 4) and (found := end(k + 4, groups + 1)):
                    return found
        if groups >= 2:
            for k in steps:
                for n in (3, 2, 1):
                    if run(k, n) and free(k + n):
                        return k + n
            if free(at):
                return at
        return None

    out, at = [], 0
    while at < len(text):
        head = text[at : at + 4]
        if free(at - 1) and len(head) == 4 and head.isascii() and head[:2].isalpha() and head[:2].isupper() and head[2:].isdigit() and (to := end(at + 4, 0)):
            number = text[at:to].replace(" ", "")
            value = "".join(str("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ".index(c)) for c in number[4:] + number[:4])
            if 15 <= len(number) <= 34 and int(value) % 97 == 1:
                out.append((at, to))
            at = to
        else:
            at += 1
    return out


def ssn_by_hand(text):
    out = []
    for at in range(len(text) - 10):
        part = text[at : at + 11]
        a, b, c = part[:3], part[4:6], part[7:]
        shaped = part[3] == part[6] == "-" and all(x.isascii() and x.isdigit() for x in a + b + c) and a not in ("000", "666") and a[0] != "9" and b != "00" and c != "0000"
        alone = (at == 0 or text[at - 1] not in "0123456789-") and (at + 11 >= len(text) or text[at + 11] not in "0123456789-")
        near = f"{text[max(0, at - 60) : at]} {text[at + 11 : at + 71]}".lower()
        if shaped and alone and (re.search(r"\bssn\b", near) or "social security" in near):
            out.append((at, at + 11))
    return out


def test_pii_added_kinds_are_brute_force(spark):
    r = np.random.RandomState(8)

    def account(country, body):
        for check in range(2, 99):
            number = f"{country}{check:02d}{body}"
            if pii.mod97(number):
                return number
        raise AssertionError(body)

    made = []
    for k in range(400):
        body = "".join(r.choice(list("0123456789ABCXYZ"), r.randint(11, 31)))
        number = account("".join(r.choice(list("DEFRGB"), 2)), body)
        spaced = " ".join(number[j : j + 4] for j in range(0, len(number), 4))
        wrong = number[:5] + ("1" if number[5] != "1" else "2") + number[6:]
        social = f"{r.randint(0, 1000):03d}-{r.randint(0, 100):02d}-{r.randint(0, 10000):04d}"
        parts = [number, spaced, wrong, f"x{number}", f"{number}x", social, f"SSN {social}", f"({social})", "social security", prose(12, k), f"{social}-1", "DE12 3456"]
        made.append(" ".join(parts[j] for j in r.permutation(len(parts))[: r.randint(1, 6)]))
    made += ["".join(r.choice(list("DE12 -9a"), 80)) for _ in range(400)] + ["", "123-45-6789 ssn", "ssn " + "y" * 60 + " 123-45-6789", "ssn " + "y" * 57 + " 123-45-6789"]
    got = {x.doc_id: x.spans for x in pii.find_pii(spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")).collect()}
    seen = Counter()
    for k, text in enumerate(made):
        own = [x for x in got[k].split(",") if x.startswith(("iban", "ssn"))]
        assert own == [f"{kind}:{a}:{b}" for a, kind, b in sorted([(a, "iban", b) for a, b in iban_by_hand(text)] + [(a, "ssn", b) for a, b in ssn_by_hand(text)])], text
        seen.update(x.split(":")[0] for x in own)
    assert seen["iban"] > 100 and seen["ssn"] > 30


def test_redaction_keeps_other_columns(spark):
    rows = [(1, "mail a@b.cc or SSN 123-45-6789"), (1, "mail a@b.cc or SSN 123-45-6789"), (2, None), (None, "")]
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    got = pii.redact(df)
    assert got.columns == df.columns and Counter(r.text for r in got.collect()) == Counter(["mail <EMAIL> or SSN <SSN>"] * 2 + [None, ""])
    assert {tuple(r)[2:] for r in got.collect()} == {tuple(r)[2:] for r in df.collect()} and pii.redact(df.where("false")).count() == 0


def test_pii_method(spark):
    rows = [(1, "IBAN DE89 3704 0044 0532 0130 00 ok"), (2, "IBAN DE89 3704 0044 0532 0130 01 no"), (3, "SSN: 123-45-6789"), (4, "part 123-45-6789"), (5, None), (None, "mail a@b.cc"), (6, "9" * 50_000), (7, "a" * 50_000 + "@"), (8, "é a@b.cc")]
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r.doc_id: r for r in pii.find_pii(df).collect()}
    assert got[1].spans == "iban:5:32" and got[2].spans == "" and got[3].spans == "ssn:5:16" and got[4].spans == ""
    assert got[5].base_sha256 == hashlib.sha256(b"").hexdigest() and got[None].spans == "email:5:11" and got[8].spans == "email:2:8"
    assert pii.find_pii(df.where("false")).count() == 0
    done = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert done[8] == "é <EMAIL>" and done[5] is None and done[4] == rows[3][1]


# --- LM scoring ---


def paths(code):
    """symbol -> [(node, bit, depth)]"""
    return [list(zip(code.node[f : f + n].tolist(), code.bit[f : f + n].tolist(), code.depth[f : f + n].tolist(), strict=True)) for f, n in zip(code.first, code.size, strict=True)]


def stirred_by_hand(x):
    for _ in range(2):
        x = (x ^ x >> 32) * 0xD6E8FEB86659FD93 & (1 << 64) - 1
    return x ^ x >> 32


def slot_by_hand(k, context, node, bits):
    return (((stirred_by_hand(context + (k + 1 << 56) & (1 << 64) - 1) + node * 0x9E3779B97F4A7C15) * 0xD6E8FEB86659FD93 & (1 << 64) - 1) >> 64 - bits) + (k << bits)


def token_events(docs, places, d):
    """For each token of each text: (symbol, contexts)."""
    out = []
    for words in docs:
        place = [places.get(w, len(d.words)) for w in words]
        symbols = [int(d.symbol[p]) for p in place]
        start = len(d.weights)
        own = []
        for k, s in enumerate(symbols):
            coded = [start, start, *(x for x in symbols[:k] if x < d.own)]
            out.append((s, (place[k - 1] if k else len(d.words) + 1, (symbols[k - 1] if k else start) << 20 | (symbols[k - 2] if k > 1 else start), coded[-1] << 20 | coded[-2])))
            own.append(s)
    return out


def letter_events(words):
    out = []
    for w in words:
        said = w if w == b"\n" else w + b" "
        for k, x in enumerate(said):
            contexts, c = [], 0
            for j in range(1, 5):
                c = c << 9 | (said[k - j] + 1 if k >= j else 0)
                contexts.append(c)
            out.append((x, tuple(contexts)))
    return out


def counts_by_hand(events, code, bits):
    n, path = defaultdict(lambda: [0, 0]), paths(code)
    for s, contexts in events:
        for node, bit, _ in path[s]:
            for k, c in enumerate(contexts):
                n[slot_by_hand(k, c, node, bits)][bit] += 1
    return n


def bit_inputs(code, bits, n, contexts, node, depth, own=None):
    found = [n.get(slot_by_hand(k, c, node, bits), (0, 0)) for k, c in enumerate(contexts)]
    if own is not None:
        found = [(max(0, a - (own == 0)), max(0, b - (own == 1))) for a, b in found]
    inputs = [float(code.logit[node]), *(math.log((b + 0.05) / (a + 0.05)) for a, b in found)]
    return inputs, sum(a != b for a, b in found) * 8 + depth


def cell_of(dot):
    x = (min(max(dot, -7.99), 7.99) + 8) * 2
    return int(x), x - int(x)


def score_by_hand(model, n, events):
    """log10 probability of each event, from counts by hand and the model's weights and map."""
    path, sig = paths(model.code), lambda x: 1 / (1 + math.exp(-x))
    out = []
    for s, contexts in events:
        said = 0.0
        for node, bit, depth in path[s]:
            inputs, gate = bit_inputs(model.code, model.bits, n, contexts, node, depth)
            dot = sum(w * x for w, x in zip(model.weights[gate], inputs, strict=True))
            low, part = cell_of(dot)
            p = (sig(dot) + sig(model.refined[node][low] * (1 - part) + model.refined[node][low + 1] * part)) / 2
            p = min(max(p, 1e-6), 1 - 1e-6)
            said += math.log10(p if bit else 1 - p)
        out.append(said)
    return out


def test_lm_scores_are_brute_force(spark, monkeypatch):
    models = []
    learn = lm_scoring.learnt
    monkeypatch.setattr(lm_scoring, "learnt", lambda *a: models.append(learn(*a)) or models[-1])
    df = clashing(documents(spark)).drop("held_out")
    rows = lm_scoring.lm_score(df, langid.remainder(F.col("doc_id"), 7) == 2, coded=9, dictionary=40).collect()
    tokens = [(i, t.encode().lower().split() + [b"\n"]) for i, t in texts(df)]
    learnt_from = [w for i, w in tokens if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2]
    train = Counter(x for w in learnt_from for x in w)
    n, v = sum(train.values()), len(train)
    ranked = sorted(((w, c) for w, c in train.items() if c > 1 and len(w) <= 64), key=lambda x: (-x[1], x[0]))[:40]
    d = lm_scoring.Dictionary.of(ranked, n, 9)
    places = {w: k for k, (w, _) in enumerate(ranked)}
    once = [w for w, c in train.items() if c == 1]
    letters, coded = models
    assert coded.code.logit.tolist() == lm_scoring.huffman(d.weights).logit.tolist()
    assert letters.code.logit.tolist() == lm_scoring.huffman([1 + sum(e[0] == k for e in letter_events(once)) for k in range(256)]).logit.tolist()
    of_letters, of_tokens = counts_by_hand(letter_events(once), letters.code, letters.bits), counts_by_hand(token_events(learnt_from, places, d), coded.code, coded.bits)
    outside = n - sum(c for _, c in ranked)
    middle = sum(c for _, c in ranked[9:])

    @lru_cache(None)
    def told(w):
        if w in places:
            return math.log10(train[w] / middle) if places[w] >= 9 else 0.0
        if train[w] > 1:
            return math.log10(train[w] / (outside + 1))
        return math.log10((len(once) + 1) / (outside + 1)) + sum(score_by_hand(letters, of_letters, letter_events([w])))

    want = []
    for i, w in tokens:
        score = sum(score_by_hand(coded, of_tokens, token_events([w], places, d))) + sum(map(told, w))
        size = sum(map(len, w)) + len(w) - 1
        base = sum(math.log10((train[x] + 1) / (n + v + 1)) for x in w)
        want.append((i is None, i or 0, len(w), sum(train[x] > 0 for x in w), base, score, -score * math.log2(10) / size))
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.n_known, r.base_score, r.score, r.bits_per_byte) for r in rows)
    for a, b in zip(got, sorted(want), strict=True):
        assert a[:4] == b[:4] and a[4:] == pytest.approx(b[4:], rel=1e-4)
    assert {r.train_tokens for r in rows} == {n}


def test_lm_mixer_learns_online(monkeypatch):
    """Weights and map after several steps, against the same steps bit by bit."""
    monkeypatch.setattr(lm_scoring, "STRIDE", 50)
    words = prose(40, 3).encode().split()
    events = letter_events(words)
    code, bits = lm_scoring.huffman([1 + sum(e[0] == k for e in events) for k in range(256)]), 12
    n = counts_by_hand(events, code, bits)
    counts = np.zeros((4 << bits, 2), np.float32)
    for slot, x in n.items():
        counts[slot] = x
    own = lm_scoring.Learner(lm_scoring.Model(code, bits, counts))
    (_, _, _, symbols, contexts), = lm_scoring.letter_reader(pa.RecordBatch.from_arrays([pa.array(words, pa.binary())], names=["word"]))
    weights, slope2 = np.full((40, 5), 0.3), np.full((40, 5), 1e-3)
    cells, path = Counter(), paths(code)
    for k, at in enumerate(range(0, len(events), 50)):
        own.learn(symbols[at : at + 50], contexts[:, at : at + 50])
        slope, seen = np.zeros((40, 5)), np.zeros(40)
        for s, c in events[at : at + 50]:
            for node, bit, depth in path[s]:
                inputs, gate = bit_inputs(code, bits, n, c, node, depth, bit)
                dot = sum(w * x for w, x in zip(weights[gate], inputs, strict=True))
                low, part = cell_of(dot)
                cells[node, low + round(part), bit] += 1
                seen[gate] += 1
                slope[gate] += (bit - 1 / (1 + math.exp(-dot))) * np.array(inputs)
        slope /= np.maximum(seen, 32)[:, None]
        slope2 = 0.95 * slope2 + 0.05 * slope**2
        weights += 0.02 / (1 + (k + 1) / 800) * slope / np.sqrt(slope2 + 1e-8)
    assert np.allclose(own.weights, weights, atol=1e-4)
    assert own.seen.tolist() == [[cells[k // 33, k % 33, bit] for bit in (0, 1)] for k in range(len(own.seen))]
    model = lm_scoring.averaged(own.model, own.used, own.weights * own.used, own.seen)
    assert lm_scoring.Scorer(model).scores(symbols, contexts).tolist() == pytest.approx(score_by_hand(model, n, events), rel=1e-3)


def learn_by_counts(own, pairs, symbols, contexts):
    """A step of the mixer that fetches zeros and ones for each bit, and takes the bit out of them there."""
    code, bits, gates = own.model.code, own.model.bits, len(own.weights)
    size, at = lm_scoring.bits_of(code, symbols)
    node, bit = code.node.take(at), code.bit.take(at)
    one = bit.astype(np.float32)
    inputs = [code.logit.take(node)]
    for k, x in enumerate(contexts):
        slots = (np.repeat(x, size) + node.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - bits)
        n = pairs.take((slots + np.uint64(k << bits)).view(np.int64))
        inputs.append(lm_scoring.logits(np.maximum(n.real - (1 - one), 0), np.maximum(n.imag - one, 0)))
    gate = code.depth.take(at)
    for x in inputs[1:]:
        gate += (x != 0) * lm_scoring.DEPTHS
    dot = np.zeros(len(gate), np.float32)
    for x, w in zip(inputs, own.weights.T.astype(np.float32), strict=True):
        dot += x * w.take(gate)
    np.add.at(own.seen.ravel(), (node * lm_scoring.STEPS + (lm_scoring.steps(dot) + np.float32(0.5)).astype(np.int64)) * 2 + bit, 1)
    wrong = one - lm_scoring.squash(dot)
    slope = np.stack([np.bincount(gate, wrong * x, gates) for x in inputs], 1) / np.maximum(np.bincount(gate, minlength=gates), 32)[:, None]
    own.slope2 = 0.95 * own.slope2 + 0.05 * slope**2
    own.done += 1
    own.weights += own.rate / (1 + own.done / 800) * slope / np.sqrt(own.slope2 + 1e-8)


def test_lm_learner_costs_less_than_counts_of_each_bit():
    """The same weights and map as from counts that are fetched and taken a logarithm of for each bit, in at most four fifths of the time."""
    r = np.random.RandomState(7)
    words = [prose(4, k).split()[j % 4].encode() + b"%d" % r.randint(50) for k in range(400) for j in range(20)]
    code = lm_scoring.huffman([1 + sum(w.count(k) for w in words) for k in range(256)])
    read = [(symbols, contexts) for *_, symbols, contexts in lm_scoring.letter_reader(pa.RecordBatch.from_arrays([pa.array(words, pa.binary())], names=["word"]))]
    counts = r.randint(0, 9, (4 << 16, 2)).astype(np.float32)
    own, other = (lm_scoring.Learner(lm_scoring.Model(code, 16, counts)) for _ in range(2))
    pairs, took = counts.view(np.complex64).ravel(), ([], [])
    for _ in range(4):
        for symbols, contexts in read:
            for k in range(0, len(symbols), lm_scoring.STRIDE):
                part = symbols[k : k + lm_scoring.STRIDE], contexts[:, k : k + lm_scoring.STRIDE]
                for times, step in zip(took, (own.learn, lambda *x: learn_by_counts(other, pairs, *x)), strict=True):
                    began = time.process_time()
                    step(*part)
                    times.append(time.process_time() - began)
    assert np.allclose(own.weights, other.weights, atol=1e-4) and own.seen.sum() == other.seen.sum()
    assert np.median(took[0]) < 0.8 * np.median(took[1])


def test_lm_tokens_of_texts_are_cut_at_six_characters():
    odd = [None, "", " ", "\n", "a", "A b", "\tÄB\x0b\x0cc\r\n", "x\x00y \x1c\x1f \x7f", "\u00a0\u2003é", "end", "\n\nstart", "W" * 5000, "", None]
    for texts in ([odd[k]] for k in range(len(odd))), (odd[k:] for k in range(len(odd))):
        for some in texts:
            said, ends = lm_scoring.tokens_of(pa.array(["left out", *some], pa.string()).slice(1))
            want = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()) + [b"\n"] for t in some]
            assert said.to_pylist() == sum(want, []) and ends.tolist() == np.cumsum([len(x) for x in want]).tolist()


def test_lm_word_counts_are_whole(spark, monkeypatch):
    """Counts are given out several times by a task, and rows that are not learnt from, or not known to be, give their words without a count."""
    monkeypatch.setattr(lm_scoring, "COUNTED", 300)
    monkeypatch.setattr(lm_scoring, "CUT", 100)
    rows = [(k, None if k % 9 == 0 else prose(1 + k % 30, k) + f" only{k}", [True, False, None][k % 3]) for k in range(200)]
    got = lm_scoring.word_counts(spark.createDataFrame(rows, "doc_id long, text string, learn boolean").repartition(3), F.col("learn")).collect()
    want = Counter()
    for _, t, learn in rows:
        for w in [*(t or "").encode().lower().split(), b"\n"]:
            want[w] += bool(learn)
    assert {bytes(r.word): r.c for r in got} == want and len(got) == len(want)


def test_lm_tables_and_weights_are_summed_over_tasks(spark):
    words = sorted({w.encode() for k in range(30) for w in prose(50, k).split()} | {b"\n", b"x" * 3000})
    code = lm_scoring.huffman([1 + sum(e[0] == k for e in letter_events(words)) for k in range(256)])
    want = counts_by_hand(letter_events(words), code, 14)
    rows = spark.createDataFrame([(bytearray(w),) for w in words], "word binary").repartition(5)
    model = lm_scoring.learnt(rows, lm_scoring.letter_reader, code, 4, 14)
    found = {k: model.counts[k].tolist() for k in np.flatnonzero(model.counts.any(1)).tolist()}
    assert found == {k: list(map(float, x)) for k, x in want.items()}
    assert model.weights.shape == (40, 5) and np.isfinite(model.refined).all()
    none = lm_scoring.learnt(rows.where("false"), lm_scoring.letter_reader, code, 4, 14)
    assert (none.weights == lm_scoring.START_WEIGHT).all() and not none.counts.any()


def test_lm_codes_are_prefix_codes_of_least_length():
    r = np.random.RandomState(2)
    for n in (1, 2, 3, 40):
        weights = r.randint(1, 1000, n).tolist()
        code = lm_scoring.huffman(weights)
        bits = ["".join(str(b) for _, b, _ in p) for p in paths(code)]
        assert n == 1 or sum(2.0 ** -len(b) for b in bits) == 1
        assert all(not a.startswith(b) for k, a in enumerate(bits) for j, b in enumerate(bits) if j != k)
        entropy = -sum(w / sum(weights) * math.log2(w / sum(weights)) for w in weights)
        assert entropy - 1e-9 <= sum(w * len(b) for w, b in zip(weights, bits, strict=True)) / sum(weights) < entropy + 1


def test_lm_is_a_distribution_over_words(spark, monkeypatch):
    """After any text, the probabilities of all next symbols add up to one, and so do the shares of the words behind a symbol."""
    d = lm_scoring.Dictionary.of([(b"a", 9), (b"b", 7), (b"c", 4), (b"d", 2)], 30, 2)
    assert d.weights == [9, 7, 6, 9] and d.symbol.tolist() == [0, 1, 2, 2, 3] and 10 ** d.extra[2] + 10 ** d.extra[3] == pytest.approx(1)
    rows = spark.createDataFrame([(bytearray(np.array([0, 1, 2, 4, 0, 3], "<i4").tobytes()),)] * 3, "places binary")
    model = lm_scoring.learnt(rows, lm_scoring.token_reader(d), lm_scoring.huffman(d.weights), 3, 12)
    for before in ([], [0], [4, 1], [2, 0, 1]):
        total = 0.0
        for symbol in range(4):
            place = [*before, [0, 1, 2, 4][symbol]]
            batch = pa.RecordBatch.from_arrays([pa.array([np.array(place, "<i4").tobytes()])], names=["places"])
            (*_, symbols, contexts), = lm_scoring.token_reader(d)(batch)
            total += 10 ** lm_scoring.Scorer(model).scores(symbols, contexts)[-1]
        assert total == pytest.approx(1, abs=1e-4)


def test_lm_edges(spark):
    assert lm_scoring.lm_score(empty(spark), F.lit(False)).count() == 0
    rows = lm_scoring.lm_score(documents(spark), F.lit(True)).collect()
    assert len(rows) == documents(spark).count()
    assert all(r.train_tokens == 0 and r.n_known == 0 and math.isfinite(r.score) and r.score < 0 for r in rows)


def test_lm_prefers_text_like_its_own(spark):
    rows = [(k, prose(60, k)) for k in range(60)]
    noise = [(100 + k, " ".join(w[::-1] + "zq" for w in prose(60, k).split())) for k in range(10)]
    fresh = [(200 + k, prose(60, 500 + k)) for k in range(10)]
    df = spark.createDataFrame(rows + noise + fresh, "doc_id long, text string")
    got = {r.doc_id: r for r in lm_scoring.lm_score(df, F.col("doc_id") >= 100).collect()}
    assert max(got[i].bits_per_byte for i, _ in fresh) < min(got[i].bits_per_byte for i, _ in noise)


def test_lm_contexts_that_cross_words_help(spark):
    """Words that follow one another by a rule: with the order kept, the same words cost less."""
    r = np.random.RandomState(4)
    chain = lambda k: " ".join(f"w{(k + 7 * j) % 30}" for j in range(60))
    mixed = lambda k: " ".join(r.permutation(chain(k).split()))
    rows = [(k, chain(r.randint(30))) for k in range(200)] + [(1000 + k, chain(r.randint(30))) for k in range(10)] + [(2000 + k, mixed(r.randint(30))) for k in range(10)]
    got = {r.doc_id: r.score for r in lm_scoring.lm_score(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") >= 1000).collect()}
    assert min(s for i, s in got.items() if 1000 <= i < 2000) > 3 * max(s for i, s in got.items() if i >= 2000) / 4


# --- quality ---


def measured_by_force(text):
    words = WORD.findall(text)
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    often = Counter(windows)
    marked = {j for k, w in enumerate(windows) if often[w] > 1 for j in range(k, k + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(marked)


def test_quality_is_brute_force(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").unionByName(clashing(documents(spark)).select(F.col("doc_id") + 100_000, "text").toDF("doc_id", "text"))
    want = Counter((i, *measured_by_force(t)) for i, t in texts(df))
    rows = quality.with_policy(quality.ledger(df)).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows) == want
    assert all(r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not (r.kept and r.base_failed) for r in rows)


def test_quality_of_long_texts_by_pieces(monkeypatch):
    r = np.random.RandomState(8)
    text = " \n".join(" ".join(r.choice(WORDS, 30)) + "\t" for _ in range(60)) + "\n\nsame line\n \nsame line\nend"
    for most in (5, 64, 700, 1 << 20):
        monkeypatch.setattr(quality, "pieces", lambda raw, most=most: common.pieces(raw, most))
        m = quality.measured(text)
        words = WORD.findall(text)
        assert tuple(m[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == measured_by_force(text)
        assert (m["n_lines"], m["n_stutters"]) == (63, sum(a == b for a, b in zip(words, words[1:])))


def test_quality_of_a_long_text_takes_little_memory():
    """A text of 30 MB, in a process of its own: its growth is what a task must hold."""
    code = """
import resource, random
from attest.llm import quality
text = " ".join(random.Random(1).choices([f"w{k}" for k in range(50_000)], k=4_600_000)) + "\\n" * 1_000_000
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
m = quality.measured(text)
print(m["n_words"], len(text) >> 20, (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) >> 10)
"""
    said = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=os.path.dirname(os.path.dirname(os.path.dirname(__file__)))).stdout.split()
    assert said[0] == "4600000" and int(said[1]) >= 28 and int(said[2]) < 400


def test_policies_and_ablations(spark, sf_dir):
    rows = quality.ledger(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    bits = [r.fail_bits for r in rows.collect()]
    for version in quality.POLICIES:
        m = quality.mask(version)
        for r in quality.ablations(rows, version).collect():
            bit = quality.BIT[r.rule]
            assert (r.rejected, r.fails, r.alone) == (sum(x & m != 0 for x in bits), sum(x & bit != 0 for x in bits), sum(x & m == bit for x in bits))


def test_clean_documents_stay_and_junk_goes(spark, sf_dir):
    folder = os.path.dirname(sf_dir) + "/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{x}.parquet") for x in ("documents", "labels"))
    rows = quality.with_policy(quality.ledger(docs)).join(labels, "doc_id").collect()
    clean = [r for r in rows if r.quality == 1 and not r.base_failed]
    junk = [r for r in rows if r.quality == 0]
    assert sum(r.kept for r in clean) >= 0.99 * len(clean)
    assert sum(r.kept for r in junk) <= 0.1 * len(junk)


def test_quality_filter_keeps_columns(spark):
    df = clashing(documents(spark))
    kept = quality.quality_filter(df)
    assert kept.columns == df.columns and 0 < kept.count() < df.count()
    assert Counter(map(tuple, kept.collect())) == Counter(tuple(r) for r in df.collect() if not quality.failed(quality.measured(r.text)) & quality.mask(quality.LATEST))
    assert quality.quality_filter(empty(spark)).count() == 0
