import json

import pytest
from pyspark.sql import functions as F

from attest.sources import scripts


def test_registry_and_lines_by_locale(spark, tmp_path):
    assert scripts.recognisers(spark, str(tmp_path)).count() == 0
    for folder in ("metadata", "models/ocr", "charsets/ocr"):
        (tmp_path / folder).mkdir(parents=True)
    stated = [{"netName": "lines_1049", "lcids": [1049, 1058]}, {"netName": "lines_1032", "lcids": [1032, 1058]}, {"netName": "lines_9", "lcids": [9]}, {"netName": "lines_8", "lcids": [8]}, {"netName": "none", "lcids": [7]}]
    (tmp_path / "metadata/ocr_scripts.json").write_text(json.dumps({"TextRecognizer": stated}, indent=1))
    for model, letters in ((1049, "ЖЯ"), (1032, "ΩΨ𐀀"), (8, "AB")):
        (tmp_path / f"charsets/ocr/{model}.txt").write_text("\n".join(str(ord(c)) for c in letters) + "\n\n")
    for model in (1049, 1032, 9):
        (tmp_path / f"models/ocr/{model}.onnx").write_bytes(b"model")
    registry = scripts.recognisers(spark, str(tmp_path))
    assert {(r.model, r.name, "".join(r.characters)) for r in registry.collect()} == {(1049, "lines_1049", "ЖЯ"), (1032, "lines_1032", "ΩΨ𐀀")}  # 9 has no charset, 8 no model
    assert {r.locale: r.model for r in scripts.locale_models(registry).collect()} == {1049: 1049, 1032: 1032, 1058: 1032}
    one = lambda k: [1.0 if j == k else 0.0 for j in range(4)]
    rows = [(1, 1049, [one(0), one(0), one(2), one(1)]), (2, 1058, [one(2), one(3), one(2)]), (3, 7, [one(1)]), (4, None, [one(3)])]
    df = spark.createDataFrame(rows, "doc_id int, locale int, steps array<array<double>>")
    got = {r.doc_id: (r.model, r.text, r.confidence) for r in scripts.read_lines(df, registry, ["x", "y", "z"]).collect()}
    assert got == {1: (1049, "ЖЯ", 1.0), 2: (1032, "𐀀𐀀", 1.0), 3: (0, "y", 1.0), 4: (0, "", 0.0)}


def test_a_charset_must_be_code_points(spark, tmp_path):
    (tmp_path / "1.txt").write_text("65\nx\n")
    with pytest.raises(Exception, match="no code point"):
        scripts.charset(spark, str(tmp_path)).collect()
    (tmp_path / "1.txt").write_text("65\n32\n960\n")
    assert scripts.charset(spark, str(tmp_path)).select(F.col("characters")).first()[0] == ["A", " ", "π"]
