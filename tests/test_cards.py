from pyspark.sql import functions as F

from attest.operators import cards

READING = "doc_id int, template string, name string, text string, confidence double"


def test_voter_fronts(spark):
    legacy, modern = cards.VOTER
    rows = [
        (1, legacy, "surname1", " GOMEZ<", 0.9), (1, legacy, "surname1", "GOMES", 0.2), (1, legacy, "surname2", "CRUZ", 0.8), (1, legacy, "givenNames", "ANA", 0.9), (1, legacy, "curp", "goca 800321 mdfmrn 05", 0.9), (1, legacy, "dateOfBirth", "21.03.1980", 0.9),
        (1, legacy, "address1", "C  5 DE MAYO 12", 0.9), (1, legacy, "address2", "COL CENTRO SN. 5", 0.9), (1, legacy, "registrationYear", "2001 03", 0.9), (1, modern, "surname1", "XX", 0.95), (1, modern, "sex", "H", 0.9),
        (2, modern, "surname1", "DIAZ", 0.7), (2, legacy, "surname1", "DIAZ", 0.7), (2, modern, "electorKey", "GMCR RR800321 09H100", 0.9), (2, modern, "address1", "av. uno  2", 0.4), (2, modern, "address3", "puebla de zaragoza", 0.4), (2, modern, "validity", "2031", 0.5), (2, modern, "sex", "H", 0.5),
        (3, legacy, "surname1", "", 0.7), (3, modern, "surname1", None, None), (4, "other", "surname1", "A", 1.0), (5, legacy, "curp", "GOCA8003", 0.9),
    ]
    got = {r.doc_id: r for r in cards.voter_fronts(spark.createDataFrame(rows, READING).repartition(5)).collect()}
    assert set(got) == {1, 2, 3, 5}
    one, two = got[1], got[2]
    assert (one.template, one.surname, one.name, one.date_of_birth, one.curp, one.sex, one.registration_year) == (legacy, "GOMEZ CRUZ", "GOMEZ CRUZ ANA", "21/03/1980", "GOCA800321MDFMRN05", "M", "2001")
    assert (one.address, one.accepted, one.confidences["surname1"]) == ("C 5 De Mayo 12, COL Centro SN. 5", True, 0.9)
    assert (two.template, two.elector_key, two.address, two.sex, two.accepted) == (modern, "GMCRRR80032109H100", "AV. UNO 2, Puebla de Zaragoza", "H", True)
    assert (got[3].template, got[3].name, got[3].accepted, got[5].accepted) == (legacy, "", False, False)
    assert cards.voter_fronts(spark.createDataFrame([], READING)).count() == 0


def test_swedish_cards(spark):
    of = lambda k, **fields: [(k, cards.SWEDISH, name, text, 0.9) for name, text in fields.items()]
    rows = of(1, surname="SVENSSON", givenNames="EVA", sex="K/F", nationality="SVENSK/SWE", dateOfBirth="21 MAR/MAR 80", personalNumber="19800321-1234", documentNumber="12345678", height="178 CM", authority="POLISMYNDIGHETEN", documentStatus="SPECIMEN", dateOfExpiry="01 FEB/FEB 27")
    rows += of(2, surname="X", nationality="DANSK/DNK", authority="POLISMYNDIGHETEN", documentNumber="1234567", personalNumber="A1") + of(3, nationality="SWE", sex="M", documentNumber="87654321", personalNumber="1")
    got = {r.doc_id: r for r in cards.swedish_cards(spark.createDataFrame(rows, READING), 2030).collect()}
    one = got[1]
    assert (one.name, one.sex, one.date_of_birth, one.date_of_expiry, one.personal_number, one.height, one.nationality, one.validity_status, one.points, one.accepted) == ("SVENSSON EVA", "F", "1980-03-21", "2027-02-01", "198003211234", "178 cm", "Sweden", 0, 7, True)
    assert [(got[k].points, got[k].accepted, got[k].nationality_code) for k in (2, 3)] == [(2, False, "DNK"), (5, True, "SWE")]


def test_specs_hold_every_field(spark):
    docs = spark.createDataFrame([(1,), (2,)], "doc_id int")
    rows = cards.field_specs(docs, tuple(cards.TEMPLATES)).collect()
    assert len(rows) == 2 * sum(map(len, cards.TEMPLATES.values())) and all(0 <= r.box[0] < r.box[2] <= 1 and 0 <= r.box[1] < r.box[3] <= 1 for r in rows)


def test_titles(spark):
    df = spark.createDataFrame([("a  b'CD 12ef",), ("ÁRBOL-de Ñ",), ("",)], "x string")
    assert [r.t for r in df.select(cards.titled(F.col("x")).alias("t")).collect()] == [x.title() for x in ("a b'CD 12ef", "ÁRBOL-de Ñ", "")]
