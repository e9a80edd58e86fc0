from pyspark.sql import functions as F

from attest.operators import readings

from .test_functions import SPECIMEN_MRV, SPECIMEN_TD1, SPECIMEN_TD3

READING = "doc_id int, no int, lines array<string>, confidences array<double>"


def test_best_readings_and_stages(spark):
    bad = [SPECIMEN_TD3[0], "M" + SPECIMEN_TD3[1][1:]]
    rows = [(1, 0, bad, [0.9, 0.9]), (1, 1, SPECIMEN_TD3, [0.5, 0.5]), (1, 2, SPECIMEN_TD3, [0.6, 0.6]), (2, 0, ["x"], [0.9]), (2, 1, bad, [0.1, 0.1]), (3, 0, SPECIMEN_MRV, [0.5, 0.5])]
    df = spark.createDataFrame(rows, READING)
    assert {r.doc_id: (r.no, r.checks) for r in readings.best_readings(df, "TD3").collect()} == {1: (2, 5), 2: (1, 3), 3: (0, 0)}
    best = {r.doc_id: (r.no, r.checks, r.valid) for r in readings.best_two_line(df).collect()}
    assert best == {1: (2, 5, True), 2: (1, 3, False), 3: (0, 3, True)}
    asked = []

    def stage(keep):
        def run(docs):
            asked.append({r.doc_id for r in docs.collect()})
            return df.where(keep).join(docs, "doc_id", "left_semi")

        return run

    out = readings.staged(df.select("doc_id").distinct(), [stage(F.col("doc_id") != 2), stage(F.lit(True))], readings.best_two_line)
    assert {r.doc_id: r.stage for r in out.collect()} == {1: 0, 2: 1, 3: 0} and asked == [{1, 2, 3}, {2}]


def test_specs(spark):
    lines = spark.createDataFrame([(1, k, t, c, 0.8, 0.05) for k, (t, c) in enumerate([("X", 0.99), ("P<A", 0.9), ("P" + "<" * 43, 0.1), ("P" + "A" * 43, 0.2), ("P<AB", 0.9)])], "doc_id int, no int, text string, confidence double, top double, height double")
    first = readings.first_line_bands(lines)
    assert [r.no for r in first.orderBy("place").collect()] == [2, 3, 4, 1]
    specs = readings.second_line_specs(first.where("place = 1")).collect()
    assert len(specs) == 12 and all(r.top + r.height <= 0.995 for r in specs)
    assert readings.crop_grid(spark, a=[0, 1, 2], b=[0, 1, 2], c=[0, 1, 2], d=[0, 1, 2], e=[0, 1]).count() == 162
    o = spark.createDataFrame([(0,), (90,), (-180,), (45,)], "d int").select(readings.text_orientations(F.col("d")).alias("o")).collect()
    assert [r.o for r in o] == [[0], [270, 90], [180], [0]]


def test_adaptive_lines(spark):
    docs = spark.createDataFrame([(1,), (2,), (3,)], "doc_id int")
    asked = []

    def read(bands):
        rows = bands.collect()
        asked.append([(r.doc_id, round(r.top, 6), round(r.height, 6)) for r in rows])
        out = []
        for r in rows:
            first = len(asked) == 1
            near = (round(r.top, 3), round(r.height, 3)) == ((0.78, 0.055) if first else (0.845, 0.055))
            text = (SPECIMEN_TD3[0] if near else "P" + "<" * 20) if first else SPECIMEN_TD3[1] if near else "M" + SPECIMEN_TD3[1][1:]
            out.append((*r, text if r.doc_id != 3 else "", 0.5 + (r.height if r.doc_id == 1 else 0)))
        return spark.createDataFrame(out, bands.schema.add("text", "string").add("confidence", "double"))

    got = {r.doc_id: r for r in readings.adaptive_lines(docs, read).collect()}
    assert len(asked) == 2 and len(asked[0]) == 63 and len(set(asked[1])) == len(asked[1])
    assert [(got[k].lines, got[k].checks, got[k].top, got[k].second_top) for k in (1, 2)] == [(SPECIMEN_TD3, 5, 0.78, 0.845)] * 2
    assert got[3].checks == 0 and got[3].bands == len([x for x in asked[1] if x[0] == 3])
    low = readings.first_line_bands(spark.createDataFrame([(1, 0, "P", 0.5, 0.7, 0.05), (1, 1, "P", 0.5, 0.9, 0.05), (1, 2, "P", 0.5, 0.9, 0.06)], "doc_id int, no int, text string, confidence double, top double, height double"))
    assert [r.no for r in low.orderBy("place").collect()] == [2, 1, 0]


def test_values_templates_and_locales(spark):
    rows = spark.createDataFrame([(1, "B", 0.95), (1, "A", 0.95), (1, "A", 0.2), (2, "C", 0.5)], "doc_id int, text string, confidence double")
    assert [(r.doc_id, r.text, r.readings) for r in readings.by_value(rows).collect()] == [(1, "A", 2)]
    cards = spark.createDataFrame([(1, 0, "curp", "X", 0.5), (1, 1, "curp", "Y", 0.9), (1, 1, "other", "Z", 9.0), (1, 0, "sex", "M", 0.3)], "doc_id int, template int, name string, text string, confidence double")
    assert readings.best_template(cards, ("curp", "sex")).first()["template"] == 1
    models = spark.createDataFrame([(1049, 7)], "locale int, model int")
    assert {r.locale: r.model for r in readings.model_locale(spark.createDataFrame([(1049,), (5,), (None,)], "locale int"), models).collect()} == {1049: 7, 5: 0, None: 0}


def test_td1_backs(spark):
    mex = ["I<MEX" + SPECIMEN_TD1[0][5:], *SPECIMEN_TD1[1:]]
    rows = spark.createDataFrame([(1, 0, 0, mex, [0.1] * 3), (1, 0, 270, mex, [0.05] * 3), (1, 0, 90, ["x"], [9.0]), (2, 0, 90, SPECIMEN_TD1, [0.9] * 3)], "doc_id int, image int, rotation int, lines array<string>, confidences array<double>")
    assert [(r.doc_id, r.rotation) for r in readings.td1_backs(rows).collect()] == [(1, 270)]


def test_portraits(spark):
    regions = spark.createDataFrame([(1, "portrait", True), (2, "portrait", True), (3, "portrait", False)], "doc_id int, region string, face_expected boolean")
    found = spark.createDataFrame([(1, "portrait", 0.5), (1, "portrait", 0.3), (2, "portrait", 0.1)], "doc_id int, region string, score double")
    assert {r.doc_id: (r["count"], r.confidence, r.status) for r in readings.portrait_presence(regions, found).collect()} == {1: (2, 0.5, "pass"), 2: (0, None, "review")}
    portraits = spark.createDataFrame([(1, 0.5, [1.0, 0.0], "pass"), (1, 0.3, [0.0, 1.0], "pass"), (2, 0.9, [0.0, 1.0], "pass")], "doc_id int, score double, vector array<double>, capture string")
    selfies = spark.createDataFrame([(1, [2.0, 0.1], "real"), (2, [1.0, 0.0], "real")], "doc_id int, vector array<double>, liveness string")
    assert {r.doc_id: (r.decision, r.verification) for r in readings.portrait_comparison(portraits, selfies, 0.67).collect()} == {1: ("same_person", "pass"), 2: ("different_person", "fail")}
    points = spark.createDataFrame([([[float(k), float(2 * k)] for k in range(68)],)], "p array<array<double>>").select(readings.five_points(F.col("p")).alias("f")).first()["f"]
    assert points == [38.5, 77.0, 44.5, 89.0, 30.0, 60.0, 48.0, 96.0, 54.0, 108.0]


def test_grids_of_a_voter_card(spark):
    assert readings.curp_crops(spark).count() == 162
    names = readings.name_crops(spark).collect()
    assert len(names) == 108 and {r.line for r in names} == {0, 1, 2} and all(r.left < r.right and r.top < r.bottom for r in names)
    assert [(r.left, r.top, r.right, r.bottom) for r in readings.name_crops(spark, shifted=False).orderBy("line").collect()] == [tuple(b) for b in readings.NAME_BANDS]


def test_profiles_that_td1_is_looked_for_with(spark):
    from attest.plans import router

    df = spark.createDataFrame([(p,) for p in router.PROFILES], "p string")
    assert {r.p for r in df.where(router.td1_wanted(F.col("p"))).collect()} == {"auto_research", "aamva_pdf417", "mex_ine", "icao_td1"}
