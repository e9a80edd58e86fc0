"""Responses: closed projections of results, and what the engine can do.

Empties go (null, empty text, array, object), zeros and false stay, at every depth. Only columns that a projection names can
reach a response.
"""

from __future__ import annotations

import importlib.util
import json
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def without_empties(value: Column, kind: T.DataType) -> Column:
    """The value with its empty parts null, itself null if nothing is left."""
    if isinstance(kind, T.StringType):
        return F.nullif(value, F.lit(""))
    if isinstance(kind, T.ArrayType):
        kept = F.filter(F.transform(value, lambda x: without_empties(x, kind.elementType)), lambda x: x.isNotNull())
        return F.when(F.size(kept) > 0, kept)
    if isinstance(kind, T.StructType):
        parts = [without_empties(value[f.name], f.dataType).alias(f.name) for f in kind.fields]
        some = F.coalesce(*(F.when(p.isNotNull(), F.lit(True)) for p in parts))
        return F.when(value.isNotNull() & some, F.struct(*parts))
    if isinstance(kind, T.MapType):
        kept = F.map_filter(F.transform_values(value, lambda k, v: without_empties(v, kind.valueType)), lambda k, v: v.isNotNull())
        return F.when(F.size(kept) > 0, kept)
    return value


def envelope(data: Column) -> Column:
    return F.to_json(F.struct(F.lit("ok").alias("status"), data.alias("data")))


def failure(code: Column, message: Column) -> Column:
    return F.to_json(F.struct(F.lit("error").alias("status"), F.struct(code.alias("code"), message.alias("message")).alias("error")))


#: Groups of a document response and the result columns that they take.
DOCUMENT = {
    "identity": ("name", "surname", "given_names", "date_of_birth", "sex", "nationality"),
    "document": ("profile", "document_class", "document_number", "issuing_state", "date_of_expiry", "optional_data"),
    "validation": ("status", "n_valid", "checks", "error"),
}


def document(result: Column, kind: T.StructType, groups: dict[str, Iterable[str]] = DOCUMENT) -> Column:
    """A result grouped and cleaned; columns that no group names are left out."""
    types = {f.name: f.dataType for f in kind.fields}
    parts = []
    for group, names in groups.items():
        have = [n for n in names if n in types]
        if have:
            own = T.StructType([T.StructField(n, types[n]) for n in have])
            parts.append(without_empties(F.struct(*(result[n].alias(n) for n in have)), own).alias(group))
    return F.struct(*parts)


def shown_classification(candidates: Column, conflicts: Column) -> Column:
    """The first candidate with a document; none where the machine-readable zone contradicts it."""
    return F.when(~F.coalesce(conflicts, F.lit(False)), F.get(F.filter(candidates, lambda c: c["caption"].isNotNull()), F.lit(0)))


def shown_barcodes(symbols: Column) -> Column:
    """Symbols without verification URLs."""
    return F.filter(symbols, lambda s: ~F.coalesce(F.lower(s["text"]).startswith("http"), F.lit(False)))


def comparison(score: Column, threshold: float, model: str) -> Column:
    return F.struct(F.when(score > threshold, "same_person").otherwise("different_person").alias("decision"), F.round(score, 6).alias("score"), F.lit(threshold).alias("threshold"), F.lit(model).alias("model"))


def unsupported() -> Column:
    """What a document that no route takes comes back as."""
    return F.struct(F.lit("UNSUPPORTED").alias("profile"), F.lit(-1).alias("status"), F.lit("Unknown document").alias("document_name"), F.array().cast("array<string>").alias("sources"))


# --- options, as jobs take them ---


def boolean_option(value: object, default: bool = False, name: str = "option") -> bool:
    if value is None or value == "":
        return default
    if isinstance(value, bool):
        return value
    if isinstance(value, str) and value.strip().lower() in ("1", "true", "yes", "on", "0", "false", "no", "off"):
        return value.strip().lower() in ("1", "true", "yes", "on")
    raise ValueError(f"{name} must be boolean")


def threshold_option(value: object, default: float, name: str = "threshold") -> float:
    told = default if value in (None, "") else float(value)  # type: ignore[arg-type]
    if not 0 <= told <= 1:
        raise ValueError(f"{name} must be between 0 and 1")
    return told


def liveness_thresholds(real: object = None, spoof: object = None) -> tuple[float, float]:
    """The spoof threshold follows the other down unless it is stated."""
    high = threshold_option(real, 0.37, "threshold")
    low = threshold_option(spoof, min(0.25, high), "spoofThreshold")
    if low > high:
        raise ValueError("spoofThreshold must not exceed threshold")
    return high, low


def top_k_option(value: object, default: int = 5, most: int = 20) -> int:
    k = default if value in (None, "") else int(value)  # type: ignore[call-overload]
    if not 1 <= k <= most:
        raise ValueError(f"topK must be between 1 and {most}")
    return k


def identifier_option(value: object) -> int | None:
    """Identifiers may be negative."""
    return None if value in (None, "") else int(value)  # type: ignore[call-overload]


def field_names_option(value: object, most: int = 64) -> list[str] | None:
    """From a list or a text with commas; each once."""
    if value in (None, "", []):
        return None
    names = [x.strip() for x in (value.split(",") if isinstance(value, str) else value)]  # type: ignore[union-attr]
    if not all(names) or len(names) > most:
        raise ValueError(f"fields must be up to {most} names")
    return list(dict.fromkeys(names))


def option(body: dict, query: dict, name: str, default: object = None) -> object:
    """A body's value goes before the query's."""
    return body.get(name, query.get(name, default))


FAMILIES = {
    "zones": (True, "TD1, TD2, TD3, MRV-A, MRV-B"),
    "barcode_payloads": (True, "AAMVA records, verification URLs"),
    "catalog": (True, "search, pages, facets, relations"),
    "layouts": (True, "regions, windows, scoring, assembly"),
    "fusion": (True, "sides, page order, fold"),
    "biometric_evaluation": (True, "ROC, AUC, EER, operating points"),
    "templates": (True, "validation, comparison, policy"),
    "pixels": (True, "statistics, patches, alignment"),
    "model_inference": (False, "needs model files; a runner is plugged in at operators.observe"),
    "symbol_decoding": (False, "needs a decoder; decoded symbols are read as rows"),
    "heic": (False, "needs a codec"),
}


def capabilities() -> dict:
    """What can be done here, honestly."""
    return {"families": [{"name": k, "available": a, "scope": s} for k, (a, s) in FAMILIES.items()], "onnxruntime": importlib.util.find_spec("onnxruntime") is not None}


def health() -> str:
    return json.dumps({"status": "ok"})
