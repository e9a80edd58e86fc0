"""Language identification: multinomial naive Bayes over hashed character n-grams.

The model is fitted on a bounded sample of the labelled documents (about PER_LANGUAGE of each language, chosen by a digest of
doc_id, whole texts). It is a matrix of log probabilities, languages by ORDERS by BUCKETS, broadcast to the executors: 3 MB for
four languages. Every n-gram of every whole text is then scored in numpy, a batch of texts at a time.

Languages are taken A_PASS at a time, so that what the driver, a task and a broadcast hold is bounded (A_PASS times 0.8 MB) however
many there are: more languages mean more passes, whose best languages and posterior masses are merged for each row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, tidy, written

ORDERS, BUCKETS = (1, 2, 3), 1 << 16
#: The bound of the training sample, in documents of a language; languages of one matrix.
PER_LANGUAGE, A_PASS = 4000, 64
SMOOTHING = 0.1
LETTER = re.compile(r"[^\W\d_]")
UNKNOWN = "und"


def lettered(text: str) -> bool:
    """Whether a text holds a letter (a category L of Unicode): the class of LETTER has numbers like the half and the superscript two besides."""
    return any(m.group().isalpha() for m in LETTER.finditer(text))


def remainder(doc_id: Column, by: int) -> Column:
    """crc32 of doc_id as text, by a modulus; a null doc_id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(by))


def coded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the lower-cased texts, each followed by two zeros, and the starts and ends of the texts, interleaved."""
    low = [x.lower() for x in texts]
    sizes = np.fromiter(map(len, low), np.int64, len(low))
    starts = np.cumsum(sizes + 2) - sizes - 2
    points = np.frombuffer(("\0\0".join(low) + "\0\0\0\0").encode("utf-32-le", "surrogatepass"), np.uint32)
    return points, np.stack([starts, starts + sizes], 1).ravel()


def buckets(points: np.ndarray, order: int) -> np.ndarray:
    """The bucket of the n-gram that starts at each code point (the last two aside)."""
    n = len(points) - 2
    h = np.full(n, 0x9E3779B1 * order & 0xFFFFFFFF, np.uint32)
    for k in range(order):
        h = (h ^ points[k : k + n]) * np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(15)
    return h & np.uint32(BUCKETS - 1)


@dataclass
class Model:
    languages: list[str]
    prior: np.ndarray
    #: languages x orders x buckets, natural logarithms
    weights: np.ndarray

    def scores(self, texts: list[str]) -> np.ndarray:
        """Joint log probability, texts by languages."""
        out = np.tile(self.prior, (len(texts), 1))
        points, ends = coded(texts)
        for j, order in enumerate(ORDERS):
            at = buckets(points, order)
            for k in range(len(self.languages)):
                out[:, k] += np.add.reduceat(self.weights[k, j][at], ends, dtype=np.float64)[::2]
        return out


def language_counts(docs: DataFrame) -> dict[str, int]:
    """Documents of each language, among those with a text and a lang."""
    rows = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    return {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}


def fit(docs: DataFrame, counts: dict[str, int], languages: list[str] | None = None, per_language: int = PER_LANGUAGE) -> Model:
    """A model of some (at most A_PASS or so) of the languages counted, from rows with a text and a lang; doc_id draws the sample."""
    languages = sorted(counts if languages is None else languages)
    if not languages:
        return Model([], np.zeros(0), np.zeros((0, len(ORDERS), BUCKETS), np.float32))
    rows = docs.where(F.col("text").isNotNull()).select("doc_id", "text", "lang")
    share = F.element_at(F.create_map(*(F.lit(x) for lang in languages for x in (lang, min(1.0, per_language / counts[lang])))), F.col("lang"))
    drawn = F.pmod(F.xxhash64("doc_id", F.lit("langid")), F.lit(1 << 30)) < share * (1 << 30)
    # A table for each language and task is summed below: the sample goes to a number of tasks that its size sets.
    tasks = max(1, sum(min(per_language, counts[x]) for x in languages) // 2000)
    sample = rows.where(F.col("lang").isin(languages) & drawn).select("text", "lang").repartition(tasks)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for b in slices(batches, 0):
            texts, langs = b.column(0).to_pylist(), b.column(1).to_pylist()
            for lang in set(langs):
                own = [t for t, x in zip(texts, langs, strict=True) if x == lang and t]
                if own:
                    points, ends = coded(own)
                    inside = np.zeros(len(points) + 1, np.int32)
                    np.add.at(inside, ends[::2], 1)
                    np.add.at(inside, ends[1::2], -1)
                    inside = np.cumsum(inside)[: len(points) - 2] > 0
                    table = held.setdefault(lang, np.zeros((len(ORDERS), BUCKETS), np.int32))
                    for j, order in enumerate(ORDERS):
                        table[j] += np.bincount(buckets(points, order)[inside], minlength=BUCKETS).astype(np.int32)
        for lang, table in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([table.tobytes()], pa.binary())], ["lang", "counts"])

    def total(key: tuple, table: pa.Table) -> pa.Table:
        out = np.zeros(len(ORDERS) * BUCKETS, np.int64)
        for x in table.column("counts"):
            out += np.frombuffer(x.as_buffer(), np.int32)
        return pa.table({"lang": pa.array([key[0].as_py()]), "counts": pa.array([out.astype(np.float32).tobytes()], pa.binary())})

    found = sample.mapInArrow(tidy(count), "lang string, counts binary").groupBy("lang").applyInArrow(total, "lang string, counts binary")
    weights = np.full((len(languages), len(ORDERS), BUCKETS), np.float32(SMOOTHING))
    for r in found.toLocalIterator():
        weights[languages.index(r["lang"])] += np.frombuffer(r["counts"], np.float32).reshape(len(ORDERS), BUCKETS)
    for table in weights:
        table[:] = np.log(table / table.sum(1, dtype=np.float64, keepdims=True))
    return Model(languages, np.log(np.array([counts[x] for x in languages], float) / sum(counts.values())), weights)


def scored(docs: DataFrame, model: Model, keep: tuple[str, ...]) -> DataFrame:
    """The columns `keep`, and of the model's languages: lang (the likeliest), joint (its log probability with the text), mass (the sum over all, relative to it); null where nothing can be said."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for b in slices(batches, b_text, 1 << 20):
            texts = b.column(b_text).to_pylist()
            langs, joint, mass = [[None] * len(texts) for _ in range(3)]
            told = [k for k, t in enumerate(texts) if t and model.languages and lettered(t)]
            if told:
                got = model.scores([texts[k] for k in told])
                best = got.argmax(1)
                top = got.max(1)
                for k, i, s, m in zip(told, best.tolist(), top.tolist(), np.exp(got - top[:, None]).sum(1).tolist(), strict=True):
                    langs[k], joint[k], mass[k] = model.languages[i], s, m
            yield pa.RecordBatch.from_arrays([*b.columns[:b_text], pa.array(langs, pa.string()), pa.array(joint, pa.float64()), pa.array(mass, pa.float64())], names=[*keep, "lang", "joint", "mass"])

    b_text = len(keep)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return docs.select(*keep, "text").mapInArrow(tidy(run), f"{kinds}, lang string, joint double, mass double")


def language_id(docs: DataFrame, held_out: Column, per_language: int = PER_LANGUAGE, a_pass: int = A_PASS) -> DataFrame:
    """doc_id, held_out, lang_pred, score (posterior probability of lang_pred), one row for each row given.

    Learns from the rows where held_out (told from doc_id) is false and text and lang are not null; a prediction reads the text alone. A
    null text, one without a letter, and any text if nothing was learnt, is `und` with score 0. Ties go to the
    language that sorts first. Rows repeat as given, doc_id may be null; other columns are not read. An empty table gives an empty table.
    """
    train = docs.where(~held_out)
    counts = language_counts(train)
    names = sorted(counts)
    passes = [names[k : k + a_pass] for k in range(0, len(names), a_pass)] or [[]]
    if len(passes) == 1:
        out = scored(docs, fit(train, counts, names, per_language), ("doc_id",))
    else:
        rows, told = written(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), "langid-rows"), None
        for k, part in enumerate(passes):
            one = written(scored(rows, fit(train, counts, part, per_language), ("row", "doc_id")).withColumn("k", F.lit(-k)), "langid-pass")
            told = one if told is None else told.unionByName(one)
        best = F.max_by(F.struct("lang", "joint"), F.struct("joint", "k")).alias("best")
        merged = told.groupBy("row").agg(F.first("doc_id").alias("doc_id"), best, F.collect_list(F.struct("joint", "mass")).alias("all"))
        mass = F.aggregate("all", F.lit(0.0), lambda s, x: s + F.coalesce(x["mass"] * F.exp(x["joint"] - F.col("best.joint")), F.lit(0.0)))
        out = merged.select("doc_id", F.col("best.lang").alias("lang"), F.when(F.col("best.joint").isNotNull(), mass).alias("mass"))
    return out.select("doc_id", held_out.alias("held_out"), F.coalesce("lang", F.lit(UNKNOWN)).alias("lang_pred"), F.coalesce(1 / F.col("mass"), F.lit(0.0)).alias("score"))
