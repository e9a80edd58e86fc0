import json

import pytest

from attest import jobs

from .test_functions import SPECIMEN_TD3


def test_requests_are_checked():
    read = jobs.read_request
    assert read("document", {"imageBase64": "x", "fields": "a, b,a", "documentIdentifier": "-7"}, {"profile": "mex_ine", "omitEmpty": "false"}).settings == {"imageBase64": "x", "profile": "mex_ine", "documentIdentifier": -7, "fields": ["a", "b"], "includeImages": False, "omitEmpty": False}
    assert read("document/classify", {"imageBase64": "x"}, {"topK": "7"}).settings["topK"] == 7
    assert read("face/liveness", {"imageBase64": "x", "threshold": 0.2}).settings == {"imageBase64": "x", "threshold": 0.2, "spoofThreshold": 0.2}
    for endpoint, body, told in (("document", {}, "imageBase64: is required"), ("document/pages", {"imagesBase64": ["a"]}, "imagesBase64: must be a list of 2 to 10"), ("face/compare", {"firstImageBase64": "a", "secondImageBase64": "b", "threshold": 2}, "threshold: "), ("document/classify", {"imageBase64": "a", "topK": 0}, "topK: "), ("nowhere", {}, "unknown endpoint"), ("document", {"imageBase64": "a", "omitEmpty": "perhaps"}, "omitEmpty: ")):
        with pytest.raises(ValueError, match=told):
            read(endpoint, body)


def test_request_tables(spark):
    rows = [(1, "face/template", json.dumps({"imageBase64": "x"}), None), (2, "document/classify", "{}", json.dumps({"topK": 3})), (3, "face/compare", "not json", None), (4, "document/classify", json.dumps({"imageBase64": "x"}), json.dumps({"topK": 3})), (5, "face/template", "[]", "")]
    got = {r.request_id: r for r in jobs.read_requests(spark.createDataFrame(rows, "request_id long, endpoint string, body string, query string")).collect()}
    assert (got[1].settings, got[1].status) == ("{}", 200) and json.loads(got[4].settings) == {"topK": 3}
    assert [got[k].status for k in (2, 3, 5)] == [400] * 3 and got[2].error == "imageBase64: is required" and got[5].error == "body and query must be objects"


def test_jobs_run(spark, tmp_path, capsys):
    spark.createDataFrame([(1, SPECIMEN_TD3)], "doc_id long, lines array<string>").write.parquet(f"{tmp_path}/lines")
    assert jobs.main(["zones", "--input", f"{tmp_path}/lines", "--output", f"{tmp_path}/zones", "--set", "format=TD3"]) == 0
    assert spark.read.parquet(f"{tmp_path}/zones").first()["n_valid"] == 5
    spark.createDataFrame([(1, [1.0, 0.0], [1.0, 0.1])], "pair long, first array<float>, second array<float>").write.parquet(f"{tmp_path}/pairs")
    assert jobs.main(["templates", "--input", f"{tmp_path}/pairs", "--output", f"{tmp_path}/told", "--set", "threshold=0.5"]) == 0
    assert spark.read.parquet(f"{tmp_path}/told").first()["comparison"]["decision"] == "same_person"
    for k in range(3):
        assert jobs.main(["zones", "--input", f"{tmp_path}/lines", "--output", f"{tmp_path}/again{k}", "--timings", f"{tmp_path}/times"]) == 0
    assert jobs.main(["templates", "--input", f"{tmp_path}/pairs", "--output", f"{tmp_path}/again", "--timings", f"{tmp_path}/times"]) == 0
    times = spark.read.parquet(f"{tmp_path}/times").collect()
    assert sorted((r.job, r.rows) for r in times) == [("templates", 1), *[("zones", 1)] * 3] and all(r.milliseconds > 0 and r.started and r.output.startswith(str(tmp_path)) for r in times)
    assert jobs.main(["latencies", "--input", f"{tmp_path}/times", "--output", f"{tmp_path}/latencies", "--set", "share=0.95"]) == 0
    told = {r.job: (r.n, r.median, r.p95) for r in spark.read.parquet(f"{tmp_path}/latencies").collect()}
    zones = sorted(r.milliseconds for r in times if r.job == "zones")
    assert told["zones"] == (3, zones[1], zones[2]) and told["templates"][0] == 1
    assert jobs.main(["capabilities"]) == 0 and "families" in capsys.readouterr().out
    for bad in (["zones"], ["zones", "--input", "a", "--output", "b", "--set", "format=X"], ["zones", "--input", "a", "--output", "b", "--set", "colour=1"]):
        with pytest.raises(SystemExit):
            jobs.main(bad)
    (tmp_path / "model.onnx").write_bytes(b"x")
    assert jobs.available(spark, str(tmp_path), ["model.onnx", "other.onnx"]) == {"model.onnx": True, "other.onnx": False}
