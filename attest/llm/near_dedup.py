"""MinHash near-duplicates with sequential Bayesian verification.

Sets are the distinct word shingles of a text. Texts with equal sets are one class, and one of each class goes on. Classes
that agree in all rows of a band meet in a bucket. In a bucket of any size, candidates are never listed as all pairs:

1. each member is held against one member of its bucket (as many pairs as members): the one that meets most others in all its
   buckets together, which in a group of copies is the text that they were made from;
2. links that are confirmed give components; buckets that lie within one component have nothing more to tell. Where
   more than BLOCK members lie outside a bucket's largest component, one of the second largest is the next pivot, for some rounds;
3. in the remaining buckets, the members outside the bucket's largest component are held against that component and each other,
   block by block inside a task, which puts out at most a spanning forest of the links of two blocks. Members of the largest
   component are not held against each other.

A comparison first reads the signatures in batches: after each, the pair is dropped if the posterior probability of a
similarity of at least the threshold, given the matches so far and a uniform prior, is under MISS. What survives is decided
on the full sets (of 64-bit hashes of shingles), in integers. A link is lost only where no band agrees, at most (1 - t^ROWS)^BANDS (5e-8 at 0.8), or where
MISS strikes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, bloom, free_name, grams, sieve, slices, stirred, tidy, words_of, written
from .graph import components

BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
BATCH = 16
MISS = 1e-6
#: Members of a bucket that one task holds against as many others, and the shingles that their sets have at most together.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 21
#: Rounds of pivots after the first, for buckets with more than BLOCK members outside their largest component.
PIVOT_ROUNDS = 4
SHINGLE, PERCENT = 5, 80

_rng = np.random.RandomState(7)
_A = (_rng.randint(0, 1 << 31, HASHES, dtype=np.int64).astype(np.uint32) << np.uint32(1)) | np.uint32(1)
_B = _rng.randint(0, 1 << 31, HASHES, dtype=np.int64).astype(np.uint32) * np.uint32(2)


def shingles(words: list[bytes], k: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; fewer than k words are one shingle, none are none."""
    return np.unique(grams(hashes.of(words), min(k, len(words)))) if words else np.empty(0, np.uint64)


def signature(found: np.ndarray) -> np.ndarray:
    low = (found >> np.uint64(32)).astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 2048):
        np.minimum(out, (np.multiply.outer(_A, low[at : at + 2048]) + _B[:, None]).min(1), out)
    return out


def least_matches(percent: int = PERCENT, miss: float = MISS) -> list[int]:
    """For each batch, the fewest matches with which a pair goes on.

    Under a uniform prior the posterior after m matches of n is Beta(m + 1, n - m + 1), whose tail above t is the
    probability that a binomial of n + 1 draws at t is at most m.
    """
    t, out = percent / 100, []
    for n in range(BATCH, HASHES + 1, BATCH):
        tail, m = 0.0, -1
        while tail < miss:
            m += 1
            tail += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append(m)
    return out


def may_be_similar(a: np.ndarray, b: np.ndarray, least: list[int]) -> np.ndarray:
    """For rows of two signature matrices: True where no batch has dropped the pair."""
    alive, seen = np.arange(len(a)), np.zeros(len(a), np.int64)
    for k, need in enumerate(least):
        cols = slice(k * BATCH, (k + 1) * BATCH)
        seen[alive] += (a[alive, cols] == b[alive, cols]).sum(1)
        alive = alive[seen[alive] >= need]
    out = np.zeros(len(a), bool)
    out[alive] = True
    return out


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Sorted distinct hashes: 100 * intersection >= percent * union."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    same = int((both[1:] == both[:-1]).sum())
    return 100 * same >= percent * (len(a) + len(b) - same)


def sketched(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, text_hash, f1 and f2 (128 bits that stand for the set), sig; for an empty set the last three are null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes(lower=True)
        for b in slices(batches, 1):
            n, f1, f2, sig = [], [], [], []
            for text in b.column(1).to_pylist():
                found = shingles(words_of(text), k, hashes)
                n.append(len(found))
                if len(found):
                    x, y = digest(found)
                    f1.append(x), f2.append(y), sig.append(signature(found).tobytes())
                else:
                    f1.append(None), f2.append(None), sig.append(None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), b.column(2), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(sig, pa.binary())], names=["doc_id", "n_shingles", "text_hash", "f1", "f2", "sig"])

    return docs.select("doc_id", "text", F.xxhash64("text")).mapInArrow(tidy(run), "doc_id long, n_shingles long, text_hash long, f1 long, f2 long, sig binary")


def digest(found: np.ndarray) -> tuple[int, int]:
    x = xxhash.xxh128_digest(found.tobytes())
    return int.from_bytes(x[:8], "little", signed=True), int.from_bytes(x[8:], "little", signed=True)


def sets_of(docs: DataFrame, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes(lower=True)
        for b in slices(batches, 1):
            sets = [shingles(words_of(x), k, hashes) for x in b.column(1).to_pylist()]
            f = [digest(x) for x in sets]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([x[j] for x in f], pa.int64()) for j in (0, 1)), pa.array([x.tobytes() for x in sets], pa.binary())], names=["doc_id", "f1", "f2", "grams"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, f1 long, f2 long, grams binary")


def band_keys(classes: DataFrame) -> DataFrame:
    """(key, id) for each class and band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                sig = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint32).reshape(-1, BANDS, ROWS)
                key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), sig.shape[:2]).copy()
                for r in range(ROWS):
                    key = stirred(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, :, r])
                ids = np.repeat(part.column(0).to_numpy(), BANDS)
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(ids)], names=["key", "id"])

    return classes.select("id", "sig").mapInArrow(tidy(run), "key long, id long")


def star_links(pairs: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b), those that are linked."""
    least = least_matches(percent)

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint32).reshape(-1, HASHES) for k in (2, 3))
                yield b.filter(pa.array(may_be_similar(x, y, least))).select([0, 1])

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [linked(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), percent) for x, y in zip(b.column(2), b.column(3), strict=True)]
            yield b.filter(pa.array(keep, pa.bool_())).select([0, 1])

    def with_both(pairs: DataFrame, side: DataFrame, what: str) -> DataFrame:
        one = pairs.join(side.select(F.col("id").alias("a"), F.col(what).alias("x")), "a")
        return one.join(side.select(F.col("id").alias("b"), F.col(what).alias("y")), "b").select("a", "b", "x", "y")

    likely = written(with_both(pairs, classes, "sig").mapInArrow(tidy(prune), "a long, b long"), "likely")  # read once more, by what is returned
    return with_both(likely, sets, "grams").mapInArrow(tidy(confirm), "a long, b long")


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Of batches in the order of their first three columns: tables that hold every row of each of their groups."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        keys = np.stack([b.column(k).to_numpy(zero_copy_only=False) for k in range(3)])
        if held and all(held[-1].column(k)[-1].as_py() == keys[k, 0] for k in range(3)):
            new = np.flatnonzero((keys != keys[:, :1]).any(0))
            if not len(new):
                held.append(b)
                continue
            yield pa.Table.from_batches([*held, b.slice(0, int(new[0]))])
            b, keys, held = b.slice(int(new[0])), keys[:, int(new[0]) :], []
        if held:
            yield pa.Table.from_batches(held)
        last = int(np.flatnonzero((keys == keys[:, -1:]).all(0))[0])
        if last:
            yield pa.Table.from_batches([b.slice(0, last)])
        held = [b.slice(last)]
    if held:
        yield pa.Table.from_batches(held)


def across(group: np.ndarray, own: np.ndarray, other: np.ndarray, component: np.ndarray, sig: np.ndarray, least: list[int], most: int = 1 << 14) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one group, of different components and of the group's two blocks, whose signatures do not rule them out; a few at a time.

    own: a row's block; other: the block that its group holds it against. Rows of a group stand together.
    """
    at, d, head = np.arange(len(group)), 1, np.ascontiguousarray(sig[:, :BATCH])
    while len(at := at[at + d < len(group)]) and len(at := at[group[at] == group[at + d]]):
        met = at[(component[at] != component[at + d]) & (own[at + d] == other[at])]
        for k in range(0, len(met), most):
            a = met[k : k + most]
            a = a[(head[a] == head[a + d]).sum(1) >= least[0]]
            ok = may_be_similar(sig[a], sig[a + d], least)
            if ok.any():
                yield a[ok], a[ok] + d
        d += 1


def block_links(members: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links across components within buckets: members (key, id, component) of buckets that hold several components.

    The signatures alone are compared first, and only members that some other may be similar to are joined with their sets. A
    block has about BLOCK members, or fewer if their sets hold more than BLOCK_SHINGLES shingles together.
    """
    least = least_matches(percent)
    told = members.join(classes.select("id", "n_shingles"), "id")
    parts = told.groupBy("key", "component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("w"))
    size = F.greatest(F.col("n") / BLOCK, F.col("w") / BLOCK_SHINGLES)
    sizes = parts.withColumn("s", size).groupBy(F.col("key").alias("k")).agg(F.max_by("component", F.struct("s", "component")).alias("major"), F.max("s").alias("m"), F.sum("s").alias("n"))
    blocks = lambda n: F.greatest(F.lit(1), F.ceil(n)).cast("int")
    sizes = sizes.select("k", "major", blocks(F.col("m")).alias("of_major"), blocks(F.col("n") - F.col("m")).alias("of_rest"))
    rows = members.join(sizes, F.col("key") == F.col("k"))
    # Blocks of the largest component have numbers from 0, those of the rest go on after them.
    in_major, place = F.col("component") == F.col("major"), F.xxhash64("id")
    rows = rows.withColumn("own", F.when(in_major, F.pmod(place, F.col("of_major"))).otherwise(F.col("of_major") + F.pmod(place, F.col("of_rest"))).cast("int"))
    met = F.sequence(F.when(in_major, F.col("of_major")).otherwise(F.lit(0)), F.col("of_major") + F.col("of_rest") - 1)
    rows = rows.withColumn("other", F.explode(met))
    rows = rows.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "id", "component", "own").join(classes.select("id", "sig"), "id")

    def read(table: pa.Table) -> tuple[np.ndarray, ...]:
        key, i, j, ids, component, own = (table.column(k).to_numpy() for k in range(6))
        sig = np.frombuffer(b"".join(table.column(6).to_pylist()), np.uint32).reshape(-1, HASHES)
        new = np.append(True, (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]))
        return np.cumsum(new), ids, component, own, np.where(own == i, j, i), sig

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches):
            group, _, component, own, other, sig = read(table)
            met = np.zeros(len(group), bool)
            for a, b in across(group, own, other, component, sig, least):
                met[a] = met[b] = True
            yield from table.filter(pa.array(met)).to_batches()

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches):
            group, ids, component, own, other, sig = read(table)
            sets, up, out = table.column(7), {}, []

            def root(c: tuple) -> tuple:
                while c in up:
                    if up[c] in up:
                        up[c] = up[up[c]]
                    c = up[c]
                return c

            for x, y in across(group, own, other, component, sig, least):
                for a, b in zip(x.tolist(), y.tolist(), strict=True):
                    one, two = root((group[a], component[a])), root((group[b], component[b]))
                    if one != two and linked(np.frombuffer(sets[a].as_py(), np.uint64), np.frombuffer(sets[b].as_py(), np.uint64), percent):
                        up[one] = two
                        out.append((ids[a], ids[b]))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    kind = "key long, i int, j int, id long, component long, own int, sig binary"
    dealt = lambda df: df.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    names = [x.split()[0] for x in kind.split(", ")]
    near = written(dealt(rows.select(*names)).mapInArrow(tidy(possible), kind), "possible")
    return dealt(near.join(sets, "id").select(*names, "grams")).mapInArrow(tidy(confirm), "a long, b long")


def open_buckets(members: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Components of the links, and the members (key, id, component) of buckets that hold several."""
    first = components(links)
    placed = members.join(first, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("c"), F.max("component").alias("d")).where(F.col("c") < F.col("d")).select(F.col("key").alias("k"))
    return first, written(placed.join(mixed, F.col("key") == F.col("k"), "left_semi"), "open")


def next_pairs(members: DataFrame) -> DataFrame:
    """For buckets (key, id, component) with more than BLOCK members outside their largest component: a member of the second largest one, with all members of other components."""
    parts = members.groupBy("key", "component").agg(F.count("*").alias("n"), F.min("id").alias("pivot"))
    two = parts.groupBy(F.col("key").alias("k")).agg(F.max(F.struct("n", "component")).alias("major"), F.sum("n").alias("all"))
    two = written(two.where(F.col("all") - F.col("major.n") > BLOCK).select("k", "major"), "wide")
    second = parts.join(two, F.col("key") == F.col("k")).where(F.col("component") != F.col("major.component")).groupBy("k").agg(F.max_by(F.struct("pivot", "component"), F.struct("n", "component")).alias("p"))
    met = members.join(second, F.col("key") == F.col("k")).where(F.col("component") != F.col("p.component"))
    return met.select(F.greatest("id", "p.pivot").alias("a"), F.least("id", "p.pivot").alias("b")).distinct()


def classed(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, text_hash, component_id: one row for each row given."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = written(sketched(docs, shingle), "sketches")
    sets = rows.where(F.col("f1").isNotNull()).groupBy("f1", "f2").agg(F.min("doc_id").alias("doc"), F.first("n_shingles").alias("n_shingles"))
    sets = written(sets.where(F.col("doc").isNotNull()), "classes")
    # A class is named by its least doc_id; classes that share it, which takes a doc_id with several texts, by a hash, but for one.
    twins = sets.groupBy(F.col("doc").alias("d")).agg(F.min(F.struct("f1", "f2")).alias("head"), F.count("*").alias("n")).where("n > 1").select("d", "head")
    own = F.col("head").isNull() | (F.col("head") == F.struct("f1", "f2"))
    classes = written(sets.join(twins, F.col("doc") == F.col("d"), "left").select("f1", "f2", "doc", "n_shingles", F.when(own, F.col("doc")).otherwise(F.xxhash64("f1", "f2", "doc")).alias("id")), "named")
    heads = rows.select("f1", "f2", "doc_id", "sig").join(classes.withColumnRenamed("doc", "doc_id"), ["f1", "f2", "doc_id"])
    heads = written(heads.dropDuplicates(["f1", "f2"]).select("id", "doc_id", "n_shingles", "sig", "f1", "f2"), "heads")
    keys = band_keys(heads)
    full = keys.groupBy("key").agg(F.count("*").alias("size"), F.min("id").alias("a"), F.max("id").alias("z")).where(F.col("a") < F.col("z")).select(F.col("key").alias("k"), "size")
    members = written(keys.join(full, F.col("key") == F.col("k")).select("key", "id", "size"), "members")
    central = members.groupBy("id").agg(F.sum("size").alias("met"))
    pivots = members.join(central, "id").groupBy("key").agg(F.max_by("id", F.struct("met", -F.col("id"))).alias("pivot")).withColumnRenamed("key", "k")
    pairs = members.select("key", "id").join(pivots, F.col("key") == F.col("k")).where(F.col("id") != F.col("pivot")).select(F.greatest("id", "pivot").alias("a"), F.least("id", "pivot").alias("b")).distinct()
    ids = written(heads.join(members.select("id").distinct(), "id", "left_semi").select("id", "doc_id", "f1", "f2"), "met")
    near = sieve(docs, "doc_id", bloom(ids, "doc_id", ids.count()))
    grams_of = written(sets_of(near, shingle).join(ids, ["doc_id", "f1", "f2"]).dropDuplicates(["id"]).select("id", "grams"), "sets")
    links = written(star_links(pairs, heads, grams_of, percent), "links")
    last, still = open_buckets(members.select("key", "id"), links)
    for _ in range(PIVOT_ROUNDS):
        pairs = written(next_pairs(still), "next-pairs")
        if pairs.isEmpty():
            break
        more = written(star_links(pairs, heads, grams_of, percent), "links")
        if more.isEmpty():
            break
        links = links.unionByName(more)
        last, still = open_buckets(members.select("key", "id"), links)
    more = written(block_links(still, heads, grams_of, percent), "more-links")
    if not more.isEmpty():
        last = components(links.unionByName(more))
    # The least doc_id of a component: names of classes may be hashes.
    placed = classes.join(last, "id", "left").select("f1", "f2", "doc", F.coalesce("component", "id").alias("component"))
    least = placed.groupBy("component").agg(F.min("doc").alias("least"))
    found = written(placed.join(least, "component").select("f1", "f2", "least"), "found")
    out = rows.drop("sig").join(found, ["f1", "f2"], "left")
    # What a class without ids, or an empty set, leaves open is the row's own id.
    return out.select("doc_id", "n_shingles", "text_hash", F.coalesce("least", "doc_id").alias("component_id"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, one row for each row given.

    A text without words, or null, has no shingles and is linked with nothing; fewer words than a shingle has are one
    shingle. Links are between texts, and component_id is the least doc_id of the texts that are reached: rows that share a
    doc_id but not their text are judged each by its own text. A row whose doc_id is null passes on no link: it takes the component of its
    class, if that has an id, and is kept otherwise. Repeated rows have equal results. Other columns are not read. An empty table gives an
    empty table. Sets are held as sorted 64-bit hashes of their shingles.
    """
    return classed(docs, shingle, percent).drop("text_hash").withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def near_dedup(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of docs that near_duplicates() keeps, with the columns of docs and their values, whatever the columns are called.

    A row goes if its own text is linked with one of a smaller doc_id; other texts under the same doc_id stay. Rows without
    doc_id go if their text is that of a row with one, and stay otherwise. Repeated rows stay or go together. Null and empty texts stay; an empty table gives an
    empty table.
    """
    doc, text = free_name(docs, "_gone"), free_name(docs, "_gone_text")
    found = classed(docs, shingle, percent).where(~F.col("doc_id").eqNullSafe(F.col("component_id")))
    gone = found.select(F.col("doc_id").alias(doc), F.col("text_hash").alias(text)).distinct()
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & (F.xxhash64("text") == F.col(text))
    return docs.join(gone, same, "left_anti")
