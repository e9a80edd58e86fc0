"""The boundary to models: images in, observation rows out. A runner is any callable that takes a tensor and gives arrays.

Runners are made once for each Python worker, by a factory that is named by what is needed to make it, so that nothing heavy is
sent with the task. An image that fails gives a row with its error, never a failed job.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..operators.imaging import as_image

_made: dict[object, Callable] = {}


def once(key: object, factory: Callable[[], Callable]) -> Callable:
    """The runner of a key, made when this worker first needs it."""
    if key not in _made:
        _made[key] = factory()
    return _made[key]


def onnx_runner(path: str, output: int = 0) -> Callable[[np.ndarray], np.ndarray]:
    """One thread each: tasks are the parallelism."""
    import onnxruntime as ort

    options = ort.SessionOptions()
    options.intra_op_num_threads = options.inter_op_num_threads = 1
    options.execution_mode = ort.ExecutionMode.ORT_SEQUENTIAL
    session = ort.InferenceSession(path, options, providers=["CPUExecutionProvider"])
    name = session.get_inputs()[0].name
    return lambda tensor: session.run(None, {name: tensor})[output]


def stub_runner(classes: int) -> Callable[[np.ndarray], np.ndarray]:
    """Scores that depend on the pixels and on nothing else: stands in for a model in tests."""

    def run(tensor: np.ndarray) -> np.ndarray:
        seed = int.from_bytes(hashlib.sha256(np.ascontiguousarray(tensor).tobytes()).digest()[:4], "little")
        return np.random.RandomState(seed).rand(classes)

    return run


def observed(images: DataFrame, key: str, factory: Callable[[], Callable], tensor: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """doc_id, scores, error for images (doc_id, height, width, data)."""
    kind = images.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                try:
                    rows.append((r.doc_id, np.asarray(once(key, factory)(tensor(as_image(r.height, r.width, r.data))), float).ravel().tolist(), None))
                except Exception as e:  # noqa: BLE001  (one bad image is a row)
                    rows.append((r.doc_id, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["doc_id", "scores", "error"])

    return images.select("doc_id", "height", "width", "data").mapInPandas(run, f"doc_id {kind}, scores array<double>, error string")
