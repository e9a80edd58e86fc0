import pytest

from attest.sources import catalogs


def test_lines_are_numbered_across_splits(spark, tmp_path):
    want = {}
    for name, n in (("a.csv", 5000), ("b.csv", 3), ("c.csv", 1200)):
        lines = [f"{name} line {k} " + "x" * (k % 50) for k in range(1, n + 1)]
        (tmp_path / name).write_text("\n".join(lines) + "\n")
        want |= {(name, k): x for k, x in enumerate(lines, 1)}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = catalogs.numbered_lines(spark, str(tmp_path))
        assert rows.rdd.getNumPartitions() > 1
        got = {(r.file.rsplit("/", 1)[-1], r.line): r.value for r in rows.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == want


def test_records_go_apart_with_their_lines(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("\ufeffscore, samePerson ,pairIdentifier\n0.5,same,p1\nx,same,p2\n\n0.25,different,\"q,\"\"r\"\"\"\n0.5,perhaps,p4\n0.5,same\n2,no,p\n", encoding="utf-8")
    (tmp_path / "in" / "b.csv").write_text('"samePerson","score"\n1,1\n0,nan\n')
    good, bad = catalogs.quarantined(catalogs.checked_records(spark, f"{tmp_path}/in"), f"{tmp_path}/out")
    short = lambda r: r.file.rsplit("/", 1)[-1]
    assert sorted((short(r), r.line, r.pair_id or "", r.same_person, r.score) for r in good.collect()) == [("a.csv", 2, "p1", True, 0.5), ("a.csv", 5, 'q,"r"', False, 0.25), ("b.csv", 2, "", True, 1.0)]
    assert sorted((short(r), r.line, r.problem, r.value) for r in bad.collect()) == [("a.csv", 3, "score", "x,same,p2"), ("a.csv", 6, "label", "0.5,perhaps,p4"), ("a.csv", 7, "fields", "0.5,same"), ("a.csv", 8, "score", "2,no,p"), ("b.csv", 3, "score", "0,nan")]
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "c.csv").write_text("name,score\na,1\n")
    with pytest.raises(Exception, match="no samePerson and score"):
        catalogs.checked_records(spark, f"{tmp_path}/other").collect()
