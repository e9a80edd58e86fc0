"""Jobs: one for each entry point, run by spark-submit over tables instead of requests.

    spark-submit attest/jobs.py zones --input lines.parquet --output out.parquet --set format=TD3 --set year=2025
    spark-submit attest/jobs.py requests --input requests.jsonl --output specs.parquet

With --timings each job adds its time and its rows to a table, whose medians and 95th places the job `latencies` tells. A job's settings are read and checked before anything runs. `requests` reads a file of request bodies (JSON, one a line, with
endpoint, body and query) into checked settings, a row each, with the error of those that are not well formed.
"""

from __future__ import annotations

import argparse
import json
import os
import sys
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

if __package__ in (None, ""):  # run as a script
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from attest.functions import barcodes, mrz, vectors
from attest.operators import catalog, detection, evaluation, fusion
from attest.plans import projections, responses

Setting = Callable[[object], object]


def text_setting(default: str | None = None, choices: tuple[str, ...] = ()) -> Setting:
    def read(value: object) -> object:
        told = default if value in (None, "") else str(value)
        if choices and told not in choices:
            raise ValueError(f"must be one of {', '.join(choices)}")
        return told

    return read


def number_setting(default: int, least: int, most: int) -> Setting:
    def read(value: object) -> int:
        n = default if value in (None, "") else int(value)  # type: ignore[call-overload]
        if not least <= n <= most:
            raise ValueError(f"must be between {least} and {most}")
        return n

    return read


def flag(default: bool) -> Setting:
    return lambda value: responses.boolean_option(value, default)


def limit(default: float) -> Setting:
    return lambda value: responses.threshold_option(value, default)


def required(value: object) -> object:
    if value in (None, "", [], {}):
        raise ValueError("is required")
    return value


def pages_setting(value: object) -> object:
    if not isinstance(value, list) or not 2 <= len(value) <= fusion.MOST_PAGES:
        raise ValueError(f"must be a list of 2 to {fusion.MOST_PAGES} images")
    return value


#: What each request may state, and how it is read. Settings that an endpoint does not name are left out.
ENDPOINTS: dict[str, dict[str, Setting]] = {
    "document": {"imageBase64": required, "profile": text_setting("auto_research"), "documentIdentifier": responses.identifier_option, "fields": responses.field_names_option, "includeImages": flag(False), "omitEmpty": flag(True)},
    "document/pair": {"frontImageBase64": required, "backImageBase64": required, "profile": text_setting("auto_research"), "frontDocumentIdentifier": responses.identifier_option, "backDocumentIdentifier": responses.identifier_option, "omitEmpty": flag(True)},
    "document/pages": {"imagesBase64": pages_setting, "profile": text_setting("auto_research"), "documentIdentifiers": lambda v: v, "omitEmpty": flag(True)},
    "document/classify": {"imageBase64": required, "topK": responses.top_k_option},
    "document/layout": {"imageBase64": required, "fields": responses.field_names_option, "omitEmpty": flag(True)},
    "document/reference-metrics": {"imageBase64": required, "documentIdentifier": lambda v: responses.identifier_option(required(v))},
    "document/portrait/compare": {"documentImageBase64": required, "selfieImageBase64": required, "threshold": limit(0.67), "checkLiveness": flag(True), "livenessThreshold": limit(0.37), "spoofThreshold": limit(0.25)},
    "face/analyze": {"imageBase64": required, "scoreThreshold": limit(0.5), "iouThreshold": limit(0.3)},
    "face/liveness": {"imageBase64": required, "threshold": limit(0.37), "spoofThreshold": limit(0.25)},
    "face/compare": {"firstImageBase64": required, "secondImageBase64": required, "threshold": limit(0.67), "includeTemplates": flag(False)},
    "face/template": {"imageBase64": required},
    "face/template/compare": {"firstTemplateBase64": required, "secondTemplateBase64": required, "threshold": limit(0.67)},
}


@dataclass(frozen=True)
class Spec:
    endpoint: str
    settings: dict[str, object]


def read_request(endpoint: str, body: dict | None = None, query: dict | None = None) -> Spec:
    """Checked settings of a request; a body's value goes before the query's. An error names the setting."""
    if endpoint not in ENDPOINTS:
        raise ValueError(f"unknown endpoint {endpoint}")
    out = {}
    for name, read in ENDPOINTS[endpoint].items():
        try:
            out[name] = read(responses.option(body or {}, query or {}, name))
        except (TypeError, ValueError) as e:
            raise ValueError(f"{name}: {e}") from e
    if {"threshold", "spoofThreshold"} <= out.keys():
        out["threshold"], out["spoofThreshold"] = responses.liveness_thresholds(*((body or {}).get(x, (query or {}).get(x)) for x in ("threshold", "spoofThreshold")))
    return Spec(endpoint, out)


def read_requests(rows: DataFrame) -> DataFrame:
    """rows: request_id, endpoint, body and query as JSON texts. request_id, endpoint, settings (JSON without images, which stay in the body), error, status."""
    kind = rows.schema["request_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                try:
                    body, query = (json.loads(x) if isinstance(x, str) and x else {} for x in (r.body, r.query))
                    if not isinstance(body, dict) or not isinstance(query, dict):
                        raise ValueError("body and query must be objects")
                    told = read_request(r.endpoint, body, query).settings
                    out.append((r.request_id, r.endpoint, json.dumps({k: v for k, v in told.items() if "Base64" not in k}, sort_keys=True), None, 200))
                except ValueError as e:
                    out.append((r.request_id, r.endpoint, None, str(e), 400))
            yield pd.DataFrame(out, columns=["request_id", "endpoint", "settings", "error", "status"])

    return rows.select("request_id", "endpoint", "body", "query").mapInPandas(run, f"request_id {kind}, endpoint string, settings string, error string, status int")


# --- the jobs ---


def zones(rows: DataFrame, settings: dict) -> DataFrame:
    """doc_id, lines -> the fields of zones of one format."""
    told = mrz.parsed(mrz.normalised(F.col("lines"), three=settings["format"] == "TD1" or None), settings["format"], settings["year"])
    return rows.select("doc_id", F.explode(F.array(told)).alias("z")).select("doc_id", "z.*")


def symbols(rows: DataFrame, settings: dict) -> DataFrame:
    """doc_id, text of PDF417 symbols -> documents."""
    return rows.select("doc_id", F.explode(F.array(barcodes.aamva_result(barcodes.parsed_aamva(F.col("text"))))).alias("r")).select("doc_id", "r.*")


def pages(rows: DataFrame, settings: dict) -> DataFrame:
    return fusion.folded_pages(rows)


def found(rows: DataFrame, settings: dict) -> DataFrame:
    """A catalog -> its documents that fit the search."""
    return catalog.search(rows, query=settings["query"], country=settings["country"], document_type=settings["type"])


def faces(rows: DataFrame, settings: dict) -> DataFrame:
    """image, anchor, score, code of a detector -> faces."""
    return detection.found_faces(rows, settings["score"], settings["overlap"])


def templates(rows: DataFrame, settings: dict) -> DataFrame:
    """Pairs of templates (first, second: arrays of floats) -> their likeness and the decision."""
    score = vectors.similarity(F.col("first"), F.col("second"))
    return rows.withColumn("comparison", responses.comparison(score, settings["threshold"], "cosine")).drop("first", "second")


def errors(rows: DataFrame, settings: dict) -> DataFrame:
    """same_person, score -> operating points of the exact ROC curve."""
    return evaluation.curve(rows)


def documents(rows: DataFrame, settings: dict) -> DataFrame:
    """Results (see plans.projections) -> responses."""
    return projections.answered(projections.document_response(rows, (settings["key"],)))


JOBS: dict[str, tuple[Callable[[DataFrame, dict], DataFrame], dict[str, Setting]]] = {
    "zones": (zones, {"format": text_setting("TD3", tuple(mrz.FORMATS)), "year": number_setting(2025, 1900, 2999)}),
    "symbols": (symbols, {}),
    "pages": (pages, {}),
    "catalog": (found, {"query": text_setting(), "country": text_setting(), "type": text_setting()}),
    "faces": (faces, {"score": limit(0.5), "overlap": limit(0.3)}),
    "templates": (templates, {"threshold": limit(0.67)}),
    "roc": (errors, {}),
    "responses": (documents, {"key": text_setting("doc_id")}),
    "requests": (lambda rows, settings: read_requests(rows), {}),
    "latencies": (lambda rows, settings: evaluation.nearest_rank(rows, ["job"], "milliseconds", settings["share"]), {"share": limit(0.95)}),
}


def timed(job: str, rows: DataFrame, output: str, timings: str | None) -> None:
    """Writes rows; where timings names a table, adds a row to it: job, started, milliseconds, rows (counted while they are written), output."""
    seen = Observation()
    started, begun = datetime.now(UTC), time.perf_counter()
    rows.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(output)
    if timings:
        took = round((time.perf_counter() - begun) * 1000, 3)
        row = [(job, started, took, seen.get["rows"], output)]
        rows.sparkSession.createDataFrame(row, "job string, started timestamp, milliseconds double, rows long, output string").coalesce(1).write.mode("append").parquet(timings)


def settings_of(job: str, stated: list[str]) -> dict:
    given = dict(x.split("=", 1) for x in stated if "=" in x)
    if lost := [x for x in stated if "=" not in x] + sorted(given.keys() - JOBS[job][1].keys()):
        raise ValueError(f"{job} has no setting {', '.join(lost)}")
    out = {}
    for name, read in JOBS[job][1].items():
        try:
            out[name] = read(given.get(name))
        except (TypeError, ValueError) as e:
            raise ValueError(f"{name}: {e}") from e
    return out


def available(spark: SparkSession, folder: str, names: list[str]) -> dict[str, bool]:
    """Which of some files are below a folder, in any store that Spark reads."""
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()

    def there(name: str) -> bool:
        at = jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{name}")
        return bool(at.getFileSystem(conf).exists(at))

    return {name: there(name) for name in names}


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="attest")
    parser.add_argument("job", choices=[*JOBS, "capabilities"])
    parser.add_argument("--input")
    parser.add_argument("--output")
    parser.add_argument("--timings", help="a table that the time of this job is added to; the job latencies reads it")
    parser.add_argument("--set", action="append", default=[], metavar="NAME=VALUE")
    told = parser.parse_args(arguments)
    if told.job == "capabilities":
        print(json.dumps(responses.capabilities()))
        return 0
    if not told.input or not told.output:
        parser.error("--input and --output are required")
    try:
        settings = settings_of(told.job, told.set)
    except ValueError as e:
        parser.error(str(e))
    spark = SparkSession.builder.appName(f"attest {told.job}").getOrCreate()
    read = spark.read.json if told.input.endswith((".json", ".jsonl", ".json.gz")) else spark.read.parquet
    timed(told.job, JOBS[told.job][0](read(told.input), settings), told.output, told.timings)
    return 0


if __name__ == "__main__":
    sys.exit(main())
