"""Vectors: templates, logits, probabilities. Column expressions over arrays, computed in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def template_error(vector: Column, length: int) -> Column:
    """Why a template cannot be compared: missing, length, not_finite, zero_norm; null if it can."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (
        F.when(vector.isNull(), "missing").when(F.size(vector) != length, "length").when(odd, "not_finite").when(norm(vector) == 0, "zero_norm")
    )


def similarity(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Cosine mapped to [0, 1]; null where a norm is zero."""
    cosine = F.try_divide(dot(a, b), (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b))
    return F.when(cosine.isNotNull(), (F.least(F.greatest(cosine, F.lit(-1.0)), F.lit(1.0)) + 1) / 2)  # least and greatest pass over nulls


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp(x.cast("double") - top.cast("double")))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, y: s + y))


def argmax(values: Column) -> Column:
    """Place of the greatest value, from 0; the first of equal ones."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def top_k(values: Column, k: int) -> Column:
    """(place, value) of the k greatest, descending; the first of equal ones first. k is held within [1, size]."""
    ranked = F.array_sort(F.transform(values, lambda x, i: F.struct((-x.cast("double")).alias("neg"), i.alias("place"))))
    return F.transform(F.slice(ranked, 1, max(1, k)), lambda r: F.struct(r["place"].alias("place"), (-r["neg"]).alias("value")))


def ctc_decode(steps: Column, charset: Column) -> Column:
    """Greedy CTC over an array of score arrays: (text, confidence). The blank is the class after the last of the charset; a class repeated from the step before is dropped; confidence is the mean score of what is emitted, 0 if nothing is."""
    blank = F.size(charset)
    best = F.transform(steps, lambda s: F.struct(argmax(s).alias("k"), F.array_max(s).cast("double").alias("p")))
    paired = F.zip_with(best, F.concat(F.array(F.lit(-1)), F.slice(F.transform(best, lambda b: b["k"]), 1, F.greatest(F.size(best) - 1, F.lit(1)))), lambda b, before: F.struct(b["k"].alias("k"), b["p"].alias("p"), before.alias("before")))
    emitted = F.filter(paired, lambda b: (b["k"] != b["before"]) & (b["k"] != blank))
    text = F.array_join(F.transform(emitted, lambda b: F.try_element_at(charset, b["k"] + 1)), "")
    total = F.aggregate(emitted, F.lit(0.0), lambda s, b: s + b["p"])
    return F.struct(text.alias("text"), F.when(F.size(emitted) > 0, total / F.size(emitted)).otherwise(F.lit(0.0)).alias("confidence"))
