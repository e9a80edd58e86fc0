import random
from datetime import date

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from attest.functions import barcodes, faces, masks, mrz, national, policy, text, vectors


def value(spark, column, **inputs):
    row = spark.createDataFrame([tuple(inputs.values())], ", ".join(f"{k} {t}" for k, t in KINDS(inputs).items())) if inputs else spark.range(1)
    return row.select(column.alias("v")).first()["v"]


def KINDS(inputs):
    return {k: "array<string>" if isinstance(v, list) else "string" for k, v in inputs.items()}


def digit(s):
    return sum((0 if c == "<" else int(c) if c.isdigit() else ord(c) - 55) * (7, 3, 1)[k % 3] for k, c in enumerate(s)) % 10


SPECIMEN_TD3 = ["P<UTOERIKSSON<<ANNA<MARIA<<<<<<<<<<<<<<<<<<<", "L898902C36UTO7408122F1204159ZE184226B<<<<<10"]
SPECIMEN_TD2 = ["I<UTOERIKSSON<<ANNA<MARIA<<<<<<<<<<<", "D231458907UTO7408122F1204159<<<<<<<6"]
SPECIMEN_TD1 = ["I<UTOD231458907<<<<<<<<<<<<<<<", "7408122F1204159UTO<<<<<<<<<<<6", "ERIKSSON<<ANNA<MARIA<<<<<<<<<<"]
SPECIMEN_MRV = ["V<UTOERIKSSON<<ANNA<MARIA<<<<<<<<<<<<<<<<<<<", "L8988901C4XXX4009078F96121096ZE184226B<<<<<<"]


@pytest.mark.parametrize("name,lines,checks", [("TD3", SPECIMEN_TD3, 5), ("TD2", SPECIMEN_TD2, 4), ("TD1", SPECIMEN_TD1, 4), ("MRV-A", SPECIMEN_MRV, 3)])
def test_public_specimens(spark, name, lines, checks):
    z = value(spark, mrz.parsed(mrz.normalised(F.col("l")), name, 2012), l=lines)
    assert (z["n_valid"], z["status"], z["error"]) == (checks, 1, None)
    assert (z["surname"], z["given_names"]) == ("ERIKSSON", "ANNA MARIA")


def test_fields_of_the_td3_specimen(spark):
    z = value(spark, mrz.parsed(mrz.normalised(F.col("l")), "TD3", 2012), l=SPECIMEN_TD3)
    assert (z["document_number"], z["date_of_birth"], z["date_of_expiry"], z["sex"], z["nationality"], z["optional_data"]) == ("L898902C3", "1974-08-12", "2012-04-15", "F", "UTO", "ZE184226B")


def test_formats_do_not_take_each_other(spark):
    for lines, name in ((SPECIMEN_MRV, "TD3"), (SPECIMEN_TD3, "MRV-A"), (SPECIMEN_TD3[:1], "TD3"), (SPECIMEN_TD2, "TD3")):
        assert value(spark, mrz.parsed(mrz.normalised(F.col("l")), name, 2012), l=lines) is None
    assert value(spark, mrz.fully_valid(F.col("l")), l=SPECIMEN_TD2) is True
    assert value(spark, mrz.two_line_score(F.col("l")), l=SPECIMEN_MRV) == 3


def test_any_changed_digit_breaks_a_check(spark):
    places = [k for k, c in enumerate(SPECIMEN_TD3[1][:43]) if c.isdigit()]
    rows = [([SPECIMEN_TD3[0], SPECIMEN_TD3[1][:k] + str((int(SPECIMEN_TD3[1][k]) + 1) % 10) + SPECIMEN_TD3[1][k + 1 :]],) for k in places]
    scores = [r["s"] for r in spark.createDataFrame(rows, "l array<string>").select(mrz.score(F.col("l"), "TD3").alias("s")).collect()]
    assert max(scores) < 5


def test_check_digits_against_a_scalar(spark):
    r = random.Random(4)
    words = ["".join(r.choice("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ<") for _ in range(r.randint(0, 40))) for _ in range(200)]
    rows = spark.createDataFrame([(w,) for w in [*words, "ab", "É1"]], "w string").select("w", mrz.check_digit(F.col("w")).alias("d")).collect()
    assert all(x["d"] == digit(x["w"]) for x in rows[:-2]) and rows[-1]["d"] is None and rows[-2]["d"] is None


@pytest.mark.parametrize("kind,year,want", [("birth", 2025, {"250101": "2025-01-01", "260101": "1926-01-01", "991231": "1999-12-31"}), ("expiry", 2025, {"750101": "1975-01-01", "740101": "2074-01-01", "300230": None, "3x0101": None}), ("expiry", 2080, {"290101": "2129-01-01", "300101": "2030-01-01"})])
def test_centuries(spark, kind, year, want):
    assert {k: value(spark, mrz.date_of(F.col("x"), kind, year), x=k) for k in want} == want


def test_repairs(spark):
    collapsed = [SPECIMEN_TD3[0].rstrip("<"), SPECIMEN_TD3[1].replace("<<<<<", "")]
    assert value(spark, mrz.repaired_td3(F.col("l")), l=collapsed) == SPECIMEN_TD3
    cases = [[*SPECIMEN_TD1[:2], SPECIMEN_TD1[2] + "<"], [SPECIMEN_TD1[0][:9] + "Q" + SPECIMEN_TD1[0][9:], *SPECIMEN_TD1[1:]], [SPECIMEN_TD1[0], SPECIMEN_TD1[1][:28], SPECIMEN_TD1[2]]]
    assert [value(spark, mrz.repaired_td1(F.col("l")), l=c) for c in cases] == [SPECIMEN_TD1] * 3
    assert value(spark, mrz.repaired_td1(F.col("l")), l=["a", "b"]) == ["a", "b"]


def test_zone_geometry(spark):
    g = value(spark, mrz.physical_geometry(F.lit(1112), F.lit(88), F.lit(125.0), F.lit(88.0), F.lit(0)))
    assert (g["widthRatio"], g["heightRatio"], g["lineDistanceRatio"]) == (111.2 / 125, 8.8 / 88, None)
    assert value(spark, mrz.search_ratios(F.lit(0.1), 2))[:4] == pytest.approx([0.095, 0.11, 0.125, 0.13])
    bands = value(spark, mrz.line_bounds(F.array(*map(F.lit, (0.0, 0.7, 1.0, 1.0))), 3))
    assert len(bands) == 3 and bands[2][3] == 1.0 and bands[0][1] == pytest.approx(0.688)


def test_national_rules(spark):
    assert value(spark, national.belarus_number(F.col("x")), x="40101908000P80") == "4010190B000PB0"
    assert value(spark, national.swedish_date(F.col("x"), 2025), x="21 AUG/AUG 82") == "1982-08-21"
    assert value(spark, national.swedish_date(F.col("x"), 2025), x="no date") == "no date"
    alphabet = national.CURP_ALPHABET
    body = "HEGG560427MVZRRL0"
    good = body + str((10 - sum(alphabet.index(c) * (18 - k) for k, c in enumerate(body)) % 10) % 10)
    assert value(spark, national.curp_valid(F.col("x")), x=good) is True
    assert value(spark, national.curp_valid(F.col("x")), x=body + str((int(good[-1]) + 1) % 10)) is False
    assert value(spark, national.mexican_number(F.col("x")), x="hegg-5604z7mvzrrl04") == "HEGG5604Z7MVZRRL04"
    assert value(spark, national.corroborated_birth(F.col("v"), F.col("c"), F.col("k")), v="27/04/1956", c=good, k="ABCDEF560427XXXXXX") == "27/04/1956"
    assert value(spark, national.corroborated_birth(F.col("v"), F.col("c"), F.col("k")), v="27/05/1957", c=good, k="ABCDEF560427XXXXXX") is None
    assert value(spark, national.nearest_in_zone(F.col("w"), F.col("z")), w="ERIKSS0M", z="PXERIKSSONXANNA") == "ERIKSSON"
    merged = national.merged_names([F.col("a"), F.col("b"), F.col("c")], [F.col("d"), F.col("e"), F.col("f")], F.col("n"))
    assert value(spark, F.array(*merged), a="HERNANDEZ", b="", c="XOSE", d="HERN", e="GARCIA", f="GLORIA", n=good) == ["HERNANDEZ", "GARCIA", "GLORIA"]
    assert value(spark, national.address_line(text.title_case(F.col("x"))), x="col centro av. o'neil") == "COL Centro AV. O'Neil"
    assert value(spark, national.voter_card_accepted(F.lit("x"), F.lit("ABCDEF1234567890"), F.lit("2020"))) is True


def test_barcodes(spark):
    payload = "@\n\x1e\rANSI 636000090002DL00410278DLDAQ123456789\nDCSDOE\nDACJANE\nDBB10161986\nDBC2\nDAG1 MAIN\nDAITOWN\nDAJAZ\nDAK85001\nDCSLATER"
    p = value(spark, barcodes.parsed_aamva(F.col("x")), x=payload)
    assert (p["documentNumber"], p["familyName"], p["dateOfBirth"], p["sex"], p["address"], p["headerValid"]) == ("123456789", "LATER", "1986-10-16", "F", "1 MAIN, TOWN, AZ, 85001", True)
    u = value(spark, barcodes.verification_url(F.col("x")), x="https://qr.ine.mx/123/20990101/X/77")
    assert (u["identifier"], u["issueDate"], u["type"], u["queryIdentifier"]) == ("123", "2099-01-01", "X", "77")
    for bad in ("https://qr.ine.mx.evil/123/20990101/X/77", "https://qr.ine.mx/123/20991301/X/77", "https://qr.ine.mx/1/2/3", "ftp://qr.ine.mx/123/20990101/X/77", "not a url"):
        assert value(spark, barcodes.verification_url(F.col("x")), x=bad) is None
    assert [value(spark, barcodes.symbology(F.lit(k))) for k in (1, 11, 16, 18)] == ["Code128", "Code93", "DataMatrix", None]


MASKS = [
    ("{DAY}/{MONTH_DD}/{YEAR}", "29/02/2024", True), ("{DAY}/{MONTH_DD}/{YEAR}", "29/02/2023", False), ("{DAY} {MONTH} {YEAR}", "29 02 2024", None),
    ("{DAY} {MONTH_SPA} {YEAR}", "03 ENE 2020", True), ("{DAY} {MONTH_ENG_F} {YEAR}", "31 june 2020", False), ("{MONTH_DD}.{DAY}.{YEAR}", "12.31.19", True),
]


@pytest.mark.parametrize("mask,shown,want", MASKS)
def test_mask_dates(spark, mask, shown, want):
    assert value(spark, masks.date_valid(F.col("m"), F.col("v")), m=mask, v=shown) is want


TOKENS = [("MONTH_FRA", "août", True), ("MONTH_FRA", "aug", False), ("STATE_CODE_USA", "az", True), ("Sex_MF", "M", None), ("Sex_WM", "w", True), ("Sex_WM", "f", False), ("EYE_COLOR_D20", "BRO", True), ("EYE_COLOR_2C", "BR", True), ("Blood_group", "ab+", True), ("Blood_group", "C", False), ("WORD", "O'Neil-Ł", True), ("WORD", "A1", False), ("WORD_D", "A1", True), ("DAY_DD", "07", True), ("DAY_DD", "7", False), ("MONTH_DD", "13", False), ("OTHER", "x", None)]


@pytest.mark.parametrize("token,shown,want", TOKENS)
def test_tokens(spark, token, shown, want):
    assert value(spark, masks.token_valid(F.col("t"), F.col("v"), text.letters_nfkd(F.col("v"))), t=token, v=shown) is want


@pytest.mark.parametrize("mask,shown,want", [("{POSTAL_CODE_USA_9}", "AZ 85001-1234", True), ("{POSTAL_CODE_CAN_P1} {POSTAL_CODE_CAN_P2}", "K1A 0B1", True), ("{FOOTS}-{INCHES}", "5'11\"", True), ("{FOOTS}-{INCHES}", "9'11", False), ("{POUNDS}", "180 lb", True), ("{KGS}", "5", False), ("{METRE},{CMS}", "1,75 m", True), ("{INCHES}", "70 in", True), ("{Foot}", "6ft", True), ("{TEXT}", "x", None)])
def test_structures(spark, mask, shown, want):
    assert value(spark, masks.structure_valid(F.col("m"), F.col("v")), m=mask, v=shown) is want


def test_mask_scores(spark):
    score = lambda m, v: value(spark, masks.compatibility(F.col("m"), F.col("v")), m=m, v=v)
    assert score("DDD", "123") == pytest.approx(0.25) and score("DDD", "12A") == pytest.approx(-0.05) and score("{3D}", "123") == pytest.approx(0.25)
    assert score("{Sex_MF}", "f") == pytest.approx(0.15) and score("", "x") == 0 and score("{DAY}/{MONTH_DD}/{YEAR}", "29/02/2024") > 0 > score("{DAY}/{MONTH_DD}/{YEAR}", "29/02/2023")


def test_text(spark):
    assert value(spark, text.variants(F.col("x"), text.ICAO_LATIN), x="Müller") == ["MÜLLER", "MULLER", "MUELLER"]
    pair = lambda a, b: value(spark, text.compatible(text.variants(F.col("a"), text.ICAO_LATIN), text.variants(F.col("b"), text.ICAO_LATIN)), a=a, b=b)
    assert pair("Müller", "MUELLER") and pair("M", "MALE") and pair("MULLER", "MILLER") is False and pair("", "X") is None
    assert value(spark, text.date_key(F.col("x")), x="21/03/1980") == "19800321" == value(spark, text.date_key(F.col("x")), x="1980-03-21")
    assert value(spark, text.title_case(F.col("x")), x="o'neil s/n") == "O'Neil S/N"


def test_vectors(spark):
    e = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0]), ([1.0, 2.0], [2.0, 4.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    assert [r[0] for r in e.select(vectors.similarity(F.col("a"), F.col("b"))).collect()] == [0.5, pytest.approx(1.0), None]
    steps = spark.createDataFrame([([[0.9, 0.1, 0.0], [0.8, 0.1, 0.1], [0.1, 0.2, 0.7], [0.6, 0.3, 0.1], [0.1, 0.9, 0.0]],), ([[0.0, 0.0, 1.0]],)], "s array<array<double>>")
    got = [r[0] for r in steps.select(vectors.ctc_decode(F.col("s"), F.array(F.lit("A"), F.lit("B")))).collect()]
    assert (got[0]["text"], got[0]["confidence"]) == ("AAB", pytest.approx(0.8)) and (got[1]["text"], got[1]["confidence"]) == ("", 0.0)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.floats(-20, 20), min_size=1, max_size=20))
def test_softmax_and_top_k(spark, logits):
    row = spark.createDataFrame([(logits,)], "l array<double>")
    p, top = row.select(vectors.softmax(F.col("l")), vectors.top_k(F.col("l"), 3)).first()
    want = np.exp(np.array(logits) - max(logits))
    assert np.allclose(p, want / want.sum())
    order = sorted(range(len(logits)), key=lambda k: (-logits[k], k))[:3]
    assert [t["place"] for t in top] == order


def test_policies(spark):
    live = [value(spark, policy.liveness_decision(F.lit(x))) for x in (0.25, 0.2501, 0.37, 0.3701)]
    assert live == ["spoof", "review", "review", "real"]
    with pytest.raises(ValueError):
        policy.liveness_decision(F.lit(1.0), real=0.1, spoof=0.2)
    cases = {("same_person", "real", "pass"): "pass", ("different_person", "real", "pass"): "fail", ("same_person", "spoof", None): "fail", ("same_person", None, "pass"): "not_available", ("same_person", None, "spoof"): "review", ("same_person", "real", None): "review", ("same_person", "review", "pass"): "review", ("review", "real", "real"): "review"}
    rows = spark.createDataFrame(list(cases), "i string, l string, c string")
    assert {(r.i, r.l, r.c): r.d for r in rows.select("*", policy.verification_decision(F.col("i"), F.col("l"), F.col("c")).alias("d")).collect()} == cases
    capture = lambda *xs: value(spark, policy.capture_decision(F.array(*(F.lit(x).cast("string") for x in xs))))
    assert [capture("pass", None), capture("pass", "review"), capture(None, "not_available"), capture("real", "pass"), capture("spoof", "pass")] == ["pass", "review", "not_available", "pass", "review"]


def nms(boxes, threshold):
    def iou(a, b):
        w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
        both = max(w, 0) * max(h, 0)
        union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both
        return both / union if union > 0 else 0

    kept = []
    for _, k, b in sorted((-s, k, b) for k, (s, b) in enumerate(boxes)):
        if all(iou(b, boxes[j][1]) <= threshold for j in kept):
            kept.append(k)
    return kept


def test_suppression_is_greedy_and_idempotent(spark):
    r = np.random.RandomState(2)
    for _ in range(4):
        at = r.rand(25, 2)
        boxes = [(float(s), [float(x), float(y), float(x + w), float(y + h)]) for s, (x, y), (w, h) in zip(r.rand(25), at, r.rand(25, 2) * 0.4 + 0.05, strict=True)]
        rows = spark.createDataFrame([([(s, k, b) for k, (s, b) in enumerate(boxes)],)], "d array<struct<score:double,seq:int,box:array<double>>>")
        once = rows.select(faces.suppressed(F.col("d"), 0.3).alias("d"))
        twice = once.select(faces.suppressed(F.col("d"), 0.3).alias("d"))
        assert [x["seq"] for x in once.first()["d"]] == nms(boxes, 0.3) == [x["seq"] for x in twice.first()["d"]]


def test_boxes(spark):
    box = F.array(*map(F.lit, (0.25, 0.25, 0.75, 0.75)))
    square = F.array(*(F.array(F.lit(x), F.lit(y)) for x, y in ((10.0, 10.0), (90.0, 10.0), (90.0, 90.0), (10.0, 90.0))))
    assert value(spark, faces.source_box(box, square, F.lit(100.0), F.lit(100.0), F.lit(0))) == pytest.approx([0.3, 0.3, 0.7, 0.7])
    assert value(spark, faces.turned_back(F.array(*map(F.lit, (0.1, 0.2, 0.3, 0.4))), F.lit(90))) == pytest.approx([0.6, 0.1, 0.8, 0.3])
    assert value(spark, faces.turned_back(box, F.lit(45))) is None
    assert value(spark, faces.pixel_box(F.array(*map(F.lit, (0.005, -1.0, 0.015, 2.0))), F.lit(100), F.lit(50))) == [0, 0, 2, 50]  # halves go to the even number


def test_anchors(spark):
    a = faces.anchors(spark)
    assert a.count() == 5118 and a.select("anchor").distinct().count() == 5118
    first, last = a.orderBy("anchor").first(), a.orderBy(F.desc("anchor")).first()
    assert (first.cy, first.cx, first.h) == (0.5 / 32, 0.5 / 32, 0.1) and (last.cy, last.cx) == (0.5, 0.5)


def rotation(yaw, pitch, roll):
    a, b, c = np.radians([pitch, yaw, roll])
    x = np.array([[1, 0, 0], [0, np.cos(a), -np.sin(a)], [0, np.sin(a), np.cos(a)]])
    y = np.array([[np.cos(b), 0, np.sin(b)], [0, 1, 0], [-np.sin(b), 0, np.cos(b)]])
    z = np.array([[np.cos(c), -np.sin(c), 0], [np.sin(c), np.cos(c), 0], [0, 0, 1]])
    return z @ y @ x


def test_head_pose(spark):
    seen = (np.array(list(faces.HEAD.values())) @ rotation(10, 20, -5).T)[:, :2] * (1, -1) + 300
    p = spark.createDataFrame([(seen.ravel().tolist(),), ([1.0] * 12,), (None,)], "p array<double>").select(faces.head_pose(F.col("p")).alias("a")).collect()
    assert (p[0].a.yaw, p[0].a.pitch, p[0].a.roll) == pytest.approx((10, 20, -5), abs=1e-6)
    assert p[1].a.yaw is None and p[2].a.yaw is None


def test_similarity_transform(spark):
    src = np.random.RandomState(3).rand(5, 2)
    to = src @ np.array([[0.0, 2.0], [-2.0, 0.0]]) + (3, 4)
    t = spark.createDataFrame([(src.ravel().tolist(), to.ravel().tolist())], "p array<double>, q array<double>").select(faces.similarity_transform(F.col("p"), F.col("q")).alias("t")).first()["t"]
    m = np.array(t).reshape(2, 3)
    assert np.allclose(np.column_stack([src, np.ones(5)]) @ m.T, to)


def test_face_quality_order(spark):
    w = faces.quality_warnings(F.array(*map(F.lit, (0.0, 0.0, 0.1, 0.1))), F.lit(100), F.lit(100), F.lit(40.0), F.lit(0.0), F.lit(0.0), F.lit(2), F.lit(0.9))
    assert [x["code"] for x in value(spark, w)] == ["MULTIPLE_FACES", "FACE_TOO_SMALL", "FACE_CUTOFF", "EXCESSIVE_POSE", "COVERED_FACE"]


def test_today_is_never_read():
    import inspect

    for module in (mrz, national, masks):
        assert "current_date" not in inspect.getsource(module) and "date.today" not in inspect.getsource(module)
    assert date(2024, 2, 29)


def test_scripts_are_told_by_icao(spark):
    table = text.icao_table()
    assert len(table) > 500
    names = ["ИВАНОВ", "Иванов", "ΠΑΠΑΔΟΠΟΥΛΟΣ", "Παπαδόπουλος", "MÜLLER", "Łódź", "Щукарёв", "", None, "PETROV"]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(names)], "k int, x string")
    got = [r.v for r in df.select(text.icao_variants(F.col("x")).alias("v"), "k").orderBy("k").collect()]
    for k, want in enumerate(("IVANOV", "IVANOV", "PAPADOPOULOS", "PAPADOPOULOS", "MULLER", "LODZ", "SHCHUKAREV")):
        assert want in got[k], (names[k], got[k])
    assert "MUELLER" in got[4] and got[7] == got[8] == []
    pairs = spark.createDataFrame([("ИВАНОВ", "IVANOV"), ("ИВАНОВ", "PETROV"), ("MÜLLER", "MULLER"), ("MÜLLER", None)], "a string, b string")
    assert [r.c for r in pairs.select(text.compatible(text.icao_variants(F.col("a")), text.icao_variants(F.col("b"))).alias("c")).collect()] == [True, False, True, None]


def test_month_words_have_their_numbers():
    numbers = masks.month_numbers()
    assert [numbers[w] for w in ("IANUAR", "MARTS", "EYL", "SEN", "МАЙ", "ENE", "DEZEMBRO", "ГРУДНЯ")] == [1, 4, 8, 9, 5, 1, 12, 12]


def test_measured_structures(spark):
    told = {
        ("{FOOTS}{INCHES}", "5' 11\""): True, ("{FOOTS}{INCHES}", "5-12"): False, ("{Foot}", " 6 ft "): True, ("{Foot}", "0'"): False, ("{INCHES}", "70 in"): True, ("{INCHES}", "7"): False,
        ("{METRE}.{CMS}", "1, 82 m"): True, ("{METRE}.{CMS}", "0.30"): False, ("{METRE}.{CMS}", "4.10"): False, ("{KGS}", "80Kgs"): True, ("{KGS}", "9"): False,
        ("{POSTAL_CODE_USA_9}", "AZ 12345-6789."): True, ("{POSTAL_CODE_USA_9}", "123456"): False, ("{POSTAL_CODE_CAN_P1} {POSTAL_CODE_CAN_P2}", "k1a 0b1"): True, ("{POSTAL_CODE_CAN_P1} {POSTAL_CODE_CAN_P2}", "W1A 0B1"): False, ("{TEXT}", "x"): None,
    }
    df = spark.createDataFrame([(m, v) for m, v in told], "m string, v string")
    assert {(r.m, r.v): r.ok for r in df.select("m", "v", masks.structure_valid(F.col("m"), F.col("v")).alias("ok")).collect()} == told
