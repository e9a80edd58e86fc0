import base64
import gzip
import itertools
import json
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attest.functions import mrz
from attest.operators import catalog, evaluation, fusion, imaging, layouts, observe, pixels
from attest.plans import responses, router
from attest.sources import catalogs, images, manifest
from attest.streaming import ingest


def records(spark, genuine, impostor):
    return spark.createDataFrame([(True, float(s)) for s in genuine] + [(False, float(s)) for s in impostor], "same_person boolean, score double")


def by_definition(genuine, impostor):
    scores = sorted({*genuine, *impostor})
    points = []
    for t in [1.0, *[(a + b) / 2 for a, b in zip(scores, scores[1:], strict=False)][::-1], 0.0]:
        points.append((t, sum(s > t for s in impostor) / len(impostor), sum(s > t for s in genuine) / len(genuine)))
    eer = min(points, key=lambda p: (abs(p[1] - (1 - p[2])), p[1] + 1 - p[2]))
    roc = sorted({(f, t) for _, f, t in points} | {(0, 0), (1, 1)})
    return points, eer, sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(roc, roc[1:], strict=False))


@pytest.mark.parametrize("genuine,impostor", [([0.9, 0.8], [0.2, 0.1]), ([0.9, 0.4], [0.6, 0.1]), ([1.0, 0.5, 0.5, 0.0], [0.5, 0.0, 0.25]), (np.round(np.random.RandomState(1).rand(60), 2), np.round(np.random.RandomState(2).rand(80) * 0.8, 2))])
def test_evaluation(spark, genuine, impostor):
    df = records(spark, genuine, impostor)
    points, eer, auc = by_definition(list(genuine), list(impostor))
    got = sorted(((r.threshold, r.far, r.tar) for r in evaluation.curve(df).collect()), key=lambda p: -p[0])
    assert np.allclose(got, points)
    e = evaluation.equal_error(evaluation.curve(df)).first()
    assert (e.threshold, e.eer) == pytest.approx((eer[0], (eer[1] + 1 - eer[2]) / 2))
    assert evaluation.auc(df).first()["auc"] == pytest.approx(auc)
    for r in evaluation.at_targets(evaluation.curve(df), [0.0, 0.3]).collect():
        best = max((p for p in points if p[1] <= r.target), key=lambda p: (p[2], p[1], -p[0]))
        assert (r.threshold, r.far, r.tar) == pytest.approx(best)
    told = {r.same_person: r for r in evaluation.summary(df).collect()}
    for same, own in ((True, genuine), (False, impostor)):
        assert (told[same]["count"], told[same]["mean"], told[same]["median"]) == (len(own), pytest.approx(np.mean(own)), pytest.approx(np.median(own)))
    assert evaluation.problems(df).first()["problem"] is None
    assert evaluation.report(df, [0.0]).count() == 1


def test_evaluation_problems(spark):
    assert [evaluation.problems(records(spark, *x)).first()["problem"] for x in (([], []), ([0.9], []), ([float("nan")], [0.1]), ([2.0], [0.1]))] == ["empty", "one_class", "not_finite", "range"]


CATALOG = {"identifierMap": [
    {"outputIndex": 0, "documentIdentifier": 1, "document": {"identifier": 1, "caption": "Card front", "country": "Utopia", "isoCodes": ["UTO"], "documentType": {"name": "IdentityCard", "value": 1}, "documentFormat": {"name": "ID1", "value": 0}, "deprecated": False, "year": "2020"}},
    {"outputIndex": 1, "documentIdentifier": 2, "document": {"identifier": 2, "caption": "Card back", "country": "Utopia", "isoCodes": ["UTO", "XOM"], "documentType": {"name": "IdentityCard", "value": 1}, "documentFormat": {"name": "ID1", "value": 0}, "deprecated": True}},
    {"outputIndex": 2, "documentIdentifier": 3, "document": None},
]}


def test_document_catalog(spark, tmp_path):
    path = tmp_path / "catalog.json"
    path.write_text(json.dumps(CATALOG, indent=1))
    docs = catalogs.document_catalog(spark, str(path))
    assert {r.identifier for r in catalog.search(docs).collect()} == {1} and {r.identifier for r in catalog.search(docs, deprecated=True).collect()} == {1, 2}
    assert {r.identifier for r in catalog.search(docs, query="BACK", country="xom", document_type="identitycard", document_format="id1", deprecated=True).collect()} == {2}
    assert {(r.facet, r.value): (r.name, r["count"]) for r in catalog.facets(docs, deprecated=True).collect()} == {("country", "UTO"): ("Utopia", 2), ("country", "XOM"): ("Utopia", 1), ("type", "IdentityCard"): (None, 2), ("format", "ID1"): (None, 2)}
    assert catalogs.document_catalog(spark, str(tmp_path / "none.json")).count() == 0
    with pytest.raises(Exception, match="digest"):
        catalogs.document_catalog(spark, str(path), sha256="0").count()
    with pytest.raises(ValueError):
        catalog.page(docs, offset=-1)


def layout(identifier, caption, **more):
    return {"identifier": identifier, "caption": caption, "isoCodes": ["uto", "x"], "fields": [], "assemblies": [], **more}


def test_layout_catalog(spark, tmp_path):
    field = lambda k, name, t, **m: {"number": k, "type": t, "name": name, "bounds": [0.1, 0.1, 0.5, 0.2], "lightType": 6, **m}
    rules = [{"target": {"type": 9, "name": "full", "locale": None}, "parts": [{"kind": "field", "type": 1}, {"kind": "literal", "value": ","}, {"kind": "field", "type": 8}]}, {"target": {"type": 8, "name": "given", "locale": None}, "parts": [{"kind": "field", "type": 2}]}]
    all_of = {str(x["identifier"]): x for x in (layout(1, "Card", childDocuments=[2], fields=[field(1, "surname", 1), field(1, "surname", 1), field(2, "first", 2), field(3, "hidden", 3, lightType=1)], assemblies=rules), layout(2, "Card Side B"), layout(-3, "Booklet", pairedPages=[4]), layout(4, "Booklet Page 3"))}
    path = tmp_path / "layouts.json.gz"
    path.write_bytes(gzip.compress(json.dumps(all_of).encode()))
    ls = catalogs.layout_catalog(spark, str(path))
    assert {r.identifier: (r.role, r.ordinal, r.method) for r in layouts.page_roles(ls).collect()} == {1: ("front", None, "related_back_layout"), 2: ("back", None, "caption_marker"), -3: ("primary_page", 1, "related_numbered_page"), 4: ("numbered_page", 3, "caption_marker")}
    assert [r.name for r in layouts.text_regions(ls).orderBy("seq").collect()] == ["surname", "first"]
    assert ls.first()["country_codes"] == ["UTO"]
    edges = layouts.field_edges(ls).select(F.col("name"), "needs")
    asked = spark.createDataFrame([("full", "full"), ("first", "first")], "root string, name string")
    assert {(r.root, r.name) for r in layouts.dependencies(asked, edges).collect()} == {("full", "full"), ("full", "surname"), ("full", "given"), ("full", "first"), ("first", "first")}
    assert [r.p for r in ls.where("identifier < 0").select(layouts.profile_name(F.col("identifier")).alias("p")).collect()] == ["CATALOG-N3"]


def test_dependencies_end_on_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "name string, needs string")
    assert layouts.dependencies(spark.createDataFrame([("r", "a")], "root string, name string"), edges).count() == 3


READING = "doc_id int, pos int, type int, name string, value string, confidence double, locale int, bounds array<double>"
RULE = "rule int, target struct<type:int,name:string,locale:int>, parts array<struct<kind:string,type:int,locale:int,value:string>>"


def test_assembly(spark):
    box = [0.0, 0.0, 1.0, 1.0]
    rows = [(1, 0, 1, "a", "DOE", 0.9, None, box), (1, 1, 2, "b", "JANE", 0.8, None, [1.0, 0.5, 2.0, 1.5]), (2, 0, 1, "a", "RUA A", 0.5, None, box), (2, 1, 4, "d", "LISBOA", 0.7, None, box), (3, 0, 9, "full", "THERE", 0.1, None, box), (3, 1, 1, "a", "X", 0.9, None, box), (4, 0, 7, "z", "q", 0.9, None, box)]
    readings = spark.createDataFrame(rows, READING)
    part = lambda kind, t=None, v=None: (kind, t, None, v)
    rules = spark.createDataFrame([(1, (9, "full", None), [part("field", 1), part("literal", v=","), part("field", 2), part("literal", v="/"), part("literal", v=", "), part("field", 4)])], RULE)
    got = {r.doc_id: (r.value, round(r.confidence, 3), r.bounds) for r in layouts.assembled(readings, rules).collect()}
    assert got == {1: ("DOE,JANE", 0.85, [0.0, 0.0, 2.0, 1.5]), 2: ("RUA A, LISBOA", 0.6, box)}
    same = spark.createDataFrame([(1, 0, 1, "n", "first", 0.5, None, box), (1, 1, 1, "n", "later", 0.5, None, box)], READING)
    assert layouts.field_values(same).first()["value"] == "later"
    assert layouts.has_identity_evidence(readings.withColumn("name", F.lit("surname"))).count() == 4


def test_lines_are_chosen_apart(spark):
    rows = [(0.9, 0, "TOP", 0.1, 0.9), (0.8, 1, "NEAR TOP", 0.12, 0.9), (0.7, 2, "BELOW", 0.2, 0.5), (0.99, 3, "FAINT", 0.5, 0.1)]
    df = spark.createDataFrame([(rows,)], "r array<struct<score:double,seq:int,text:string,centre:double,confidence:double>>")
    v = df.select(layouts.selected_lines(F.col("r"), F.lit(0.1), F.lit(2)).alias("v")).first()["v"]
    assert v["value"] == "TOP\nBELOW" and v["confidence"] == pytest.approx(0.7)


def ordered_by_force(pages):
    """(position, identifier, ordinal, related) of one collection -> indices, decision, method."""
    n = len(pages)
    before = {k: set() for k in range(n)}
    for a, b in itertools.permutations(range(n), 2):
        (_, i, x, near), (_, j, y, other) = pages[a], pages[b]
        if None not in (i, j, x, y) and x < y and (j in (near or []) or i in (other or [])):
            before[b].add(a)
    told = []
    while len(told) < n:
        free = [k for k in range(n) if k not in told and before[k] <= set(told)]
        if not free:
            return list(range(n)), "preserved", "caller_order"
        told.append(free[0])
    return told, "preserved" if told == list(range(n)) else "reordered", "catalog_relation_and_declared_page_ordinal" if any(before.values()) else "caller_order"


def test_page_order_of_long_collections_and_cycles(spark):
    r = random.Random(5)
    sets = {1: [(k, k, 50 - k, [k + 1]) for k in range(50)], 2: [(k, k % 3, [1, 2, 3, 4][k % 4], [(k + 1) % 3]) for k in range(12)], 3: [(0, 5, 1, [5])], 4: [(k, 7, k % 5, [7, 7, None]) for k in range(30)]}
    for c in range(5, 60):
        sets[c] = [(k, r.choice([None, 0, 1, 2, 3]), r.choice([None, 1, 2, 3]), r.choice([None, [], [0, 1], [2], [3, 3]])) for k in range(r.randrange(1, 14))]
    rows = [(c, *p) for c, pages in sets.items() for p in pages]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "collection_id long, position int, identifier long, ordinal int, related array<long>")
    got = {x.collection_id: (x.indices, x.decision, x.method) for x in fusion.page_order(df).collect()}
    assert got == {c: ordered_by_force(pages) for c, pages in sets.items()}
    assert got[1][0] == list(range(49, -1, -1))
    assert fusion.page_order(df.where("false")).count() == 0


def test_windows(spark):
    w = spark.range(1).select(layouts.candidate_windows(F.array(*map(F.lit, (0.0, 0.4, 1.0, 0.8))), F.lit(0.05)).alias("w")).first()["w"]
    far = [abs((b[1] + b[3]) / 2 - 0.6) for b in w]
    assert 3 <= len(w) <= 10 and far == pytest.approx(sorted(far))


def test_page_order_and_fold(spark):
    kind = "collection_id int, position int, identifier long, ordinal int, related array<long>"
    rows = [(1, 0, 11, 2, [10]), (1, 1, 10, 1, [11]), (2, 0, 20, 1, []), (2, 1, 21, 2, []), (3, 0, 30, None, None), (3, 1, None, 2, None)]
    got = {r.collection_id: (r.indices, r.decision, r.method) for r in fusion.page_order(spark.createDataFrame(rows, kind)).collect()}
    assert got == {1: ([1, 0], "reordered", "catalog_relation_and_declared_page_ordinal"), 2: ([0, 1], "preserved", "caller_order"), 3: ([0, 1], "preserved", "caller_order")}
    page = "collection_id int, position int, country string, name array<string>, surname string, date_of_birth string, sex string, document_number string, mrz_strings array<string>, status int, sources array<string>, capture string"
    one = lambda c, k, name, born="", sex="", number="", mrz=(), status=0, source="VISUAL", capture=None: (c, k, "UTO", name.split(), "", born, sex, number, list(mrz), status, [source], capture)
    pages = [one(1, 0, "JOHN"), one(1, 1, "JOHNDOE", "19800321", "M", "A1", ["L"], 1, "MRZ"), one(1, 2, "JOHN", "19900101", "F", "", [], 0), one(1, 3, "MARY"), one(2, 0, "A", number="N0"), one(2, 1, "AB X", number="", capture="review"), one(3, 0, "A"), *(one(4, k, "A") for k in range(11))]
    folded = {r.collection_id: r for r in fusion.folded_pages(spark.createDataFrame(pages, page)).collect()}
    # births and sexes of later pages are not taken over: the second and third page disagree with each other, but not with the first
    assert (folded[1].decision, folded[1].page_decisions, folded[1].matched_pages) == ("mismatch", ["matched", "matched", "mismatch"], 3)
    assert (folded[1].date_of_birth, folded[1].sex, folded[1].document_number, folded[1].mrz_strings, folded[1].status, folded[1].sources) == ("", "", "A1", ["L"], 1, ["VISUAL", "MRZ"])
    assert (folded[2].decision, folded[2].document_number, folded[2].capture) == ("matched", "N0", "review")
    assert (folded[3].error, folded[3].decision) == (folded[4].error, folded[4].decision) == ("page_count", None)


def test_pairs_of_sides(spark):
    side = "struct<country:string,name:string,surname:string,given_names:string,date_of_birth:string,mrz_code:string,machine_barcodes:array<struct<format:string,text:string>>,status:int,sources:array<string>,source:string,profile:string,machine_profile:string,requested:long,candidates:array<struct<identifier:long,name:string,confidence:double>>,ine_qr:string>"
    front = ("Utopia", None, "MÜLLER", "ANNA", "21/03/1980", "", [], 0, ["VISUAL"], "VISUAL", "CATALOG-P7", None, 7, [(99, None, 0.9), (7, "Card front", 0.7)], None)
    back = ("UTO", "MUELLER ANNA", "MUELLER", "ANNA", "1980-03-21", "P<UTO", [("QR", "a")], 1, ["MRZ", "VISUAL"], "MRZ", "TD1", None, None, [(8, "Card back", 0.5)], None)
    other = ("UTO", "SOMEBODY", "ELSE", "", "", "P<X", [("QR", "z")], 1, ["MRZ"], "MRZ", "UNSUPPORTED", None, None, [], "payload")
    fronts = spark.createDataFrame([(1, front), (2, front)], f"doc_id int, front {side}")
    backs = spark.createDataFrame([(1, back), (2, other)], f"doc_id int, back {side}")
    guided = spark.createDataFrame([(1, [("QR", "a"), ("Aztec", "b"), ("QR", "a")]), (2, [("Aztec", "b")])], "doc_id int, barcodes array<struct<format:string,text:string>>")
    catalog = spark.createDataFrame([(7, "Card front", [8], []), (8, "Card back", [], [])], "identifier long, caption string, child_documents array<long>, paired_pages array<long>")
    from attest.functions import text

    got = {r.doc_id: r for r in fusion.paired(fronts, backs, catalog, guided, key=text.icao_variants).collect()}
    one, two = got[1], got[2]
    assert (one.decision, one.check_name, one.check_date_of_birth, one.relation, one.front) == ("matched", True, True, "related_document", 7)
    assert [tuple(b) for b in one.result.machine_barcodes] == [("QR", "a"), ("Aztec", "b")] and one.related_barcodes == 3
    assert (one.result.status, one.result.sources, one.result.source, one.result.profile, one.result.machine_profile, one.result.mrz_code) == (1, ["VISUAL", "MRZ"], "MULTI_SOURCE", "PAIRED-DOCUMENT", "TD1", "P<UTO")
    assert [(s.side, s.recognized, s.classification and s.classification.name) for s in one.sides] == [("front", True, "Card front"), ("back", True, None)]
    assert (two.decision, two.result.mrz_code, two.result.source, two.related_barcodes, two.sides[1].recognized) == ("mismatch", "", "VISUAL", 0, False)


def test_guided_pairs(spark):
    side = "struct<name:string,date_of_birth:string,sex:string,machine_barcodes:array<struct<format:string,text:string>>,ine_qr:string,candidates:array<struct<identifier:long,name:string,confidence:double>>>"
    one = lambda symbols, qr=None, candidates=(): ("A B", "1980-03-21", "M", symbols, qr, [(c, "card", 0.5) for c in candidates])
    fronts = spark.createDataFrame([(k, one([], candidates=c)) for k, c in ((1, [7]), (2, [7]), (3, [9, 8]), (4, []), (5, [99]))], f"doc_id int, front {side}")
    backs = spark.createDataFrame([(k, one([("Aztec", "own")], qr)) for k, qr in ((1, None), (2, "known"), (3, None), (4, None), (5, None))], f"doc_id int, back {side}")
    region = "array<struct<name:string,bounds:array<double>,lightType:int,layer:int>>"
    box = lambda x, light=6: ("b", [x, 0.1, x + 0.1, 0.2], light, 0)
    layouts_ = spark.createDataFrame([(7, "front", [8], [], []), (8, "back", [], [7], [box(0.1), box(0.1), box(0.3, 1), box(0.5)]), (9, "lone", [], [], [box(0.7)])], f"identifier long, caption string, child_documents array<long>, paired_pages array<long>, barcodes {region}")
    asked = []

    def decode(regions):
        asked.extend((r.doc_id, r.identifier, r.bounds[0]) for r in regions.collect())
        text = F.when(F.col("bounds")[0] == 0.1, F.lit("https://qr.ine.mx/1/20240101/a/2")).otherwise("other")
        return regions.select("doc_id", F.lit("QRCode").alias("format"), text.alias("text"))

    got = {r.doc_id: r for r in fusion.guided_pairs(fronts, backs, layouts_, decode).collect()}
    assert sorted(asked) == [(1, 8, 0.1), (1, 8, 0.5)]  # 2 is read already, 3 is led by its second candidate to a layout without regions, 4 and 5 to none
    assert [(got[k].regions, got[k].related_barcodes, got[k].relation) for k in range(1, 6)] == [(2, 2, "related_document"), (0, 0, "related_document"), (0, 0, "paired_page"), (0, 0, None), (0, 0, None)]
    assert [got[k].result.ine_qr for k in range(1, 4)] == ["https://qr.ine.mx/1/20240101/a/2", "known", None]
    assert [(s.format, s.text) for s in got[1].result.machine_barcodes] == [("Aztec", "own"), ("QRCode", "https://qr.ine.mx/1/20240101/a/2"), ("QRCode", "other")]
    with pytest.raises(ValueError, match="candidates"):
        fusion.guided_pairs(fronts.select("doc_id", F.struct("front.name").alias("front")), backs, layouts_, decode)


def test_router(spark):
    seen = spark.createDataFrame([(1, "auto_research", True, True, 3), (2, "auto_research", False, True, 3), (3, "auto_research", False, False, 3), (4, "icao_td3", False, False, 3), (5, "mex_ine", True, False, 0)], "doc_id int, profile string, aamva_valid boolean, td1_shaped boolean, mrv_checks int")
    assert [r.r for r in seen.select(router.route(seen).alias("r")).collect()] == ["aamva", "td1", "mrv", "rejected", "ine"]
    calls = {}

    def observer(stage, columns):
        def run(pending):
            calls[stage] = {r.doc_id for r in pending.select("doc_id").collect()}
            return pending.select("doc_id", *columns)

        return run

    docs = seen.select("doc_id", "profile")
    times = []

    def counted(stage, columns):
        """An observer whose work is counted where it is done: each row adds one."""
        done = spark.sparkContext.accumulator(0)
        times.append((stage, done))

        def look(batches):
            for b in batches:
                done.add(b.num_rows)
                yield b

        return lambda asked: asked.select("doc_id", *columns).mapInArrow(look, asked.select("doc_id", *columns).schema)

    told = router.observe_in_stages(docs, {"barcodes": counted("barcodes", [(F.col("doc_id") == 1).alias("aamva_valid")]), "td1": counted("td1", [(F.col("doc_id") == 2).alias("td1_shaped")]), "two_line": counted("two_line", [F.lit(3).alias("mrv_checks")])})
    assert {r.doc_id: (r.route, r.stages) for r in told.collect()} == {1: ("aamva", ["barcodes"]), 2: ("td1", ["barcodes", "td1"]), 3: ("mrv", ["barcodes", "td1", "two_line"]), 4: ("rejected", ["two_line"]), 5: ("ine", ["barcodes", "td1"])}
    assert {r.stage: r.documents for r in router.stage_counts(told).collect()} == {"barcodes": 4, "td1": 3, "two_line": 2}
    assert told.count() == 5 and {stage: n.value for stage, n in times} == {"barcodes": 4, "td1": 3, "two_line": 2}  # whatever is asked of the result, nothing is observed twice
    out = router.observe_in_stages(docs, {"td1": observer("td1", [(F.col("doc_id") <= 2).alias("td1_shaped")]), "two_line": observer("two_line", [F.lit(3).alias("mrv_checks")])})
    assert {r.doc_id: r.route for r in out.collect()} == {1: "td1", 2: "td1", 3: "mrv", 4: "rejected", 5: "ine"}
    assert calls["td1"] == {1, 2, 3, 5} and calls["two_line"] == {3, 4}
    assert router.observe_in_stages(docs.where("false"), {"td1": observer("td1", [F.lit(True).alias("td1_shaped")])}).count() == 0


def picture(h=40, w=60, seed=0):
    return np.random.RandomState(seed).randint(0, 256, (h, w, 3)).astype(np.uint8)


def test_pixels(spark):
    image = picture()
    flat = np.full((40, 60, 3), 100, np.uint8)
    df = spark.createDataFrame([(1, 40, 60, bytearray(image.tobytes())), (2, 40, 60, bytearray(flat.tobytes())), (3, 0, 0, None)], "doc_id int, height int, width int, data binary")
    s = {r.doc_id: r.s for r in df.select("doc_id", imaging.statistics(F.col("height"), F.col("width"), F.col("data")).alias("s")).collect()}
    assert s[2].luminance_std == 0 and s[2].luminance_mean == pytest.approx(100 / 255) and s[1].edge_mean > 0.2 and s[3].edge_mean is None
    crops = df.select(imaging.region_crop(F.col("height"), F.col("width"), F.col("data"), F.array(*map(F.lit, (0.0, 0.0, 0.5, 0.5)))).alias("c")).collect()
    assert base64.b64decode(crops[0].c).startswith(b"\x89PNG") and crops[2].c is None
    stub = observe.observed(df, "stub", lambda: observe.stub_runner(4), imaging.standardised).collect()
    assert len(stub[0].scores) == 4 and stub[2].error and stub[2].scores is None


def test_alignment_and_rectification():
    image = picture(50, 80, 3)
    identity = np.array([[1.0, 0, 0], [0, 1.0, 0]])
    assert np.allclose(imaging.warped(image, identity, 50, 80), image)
    corners = np.array([[0, 0], [80, 0], [80, 50], [0, 50]], float)
    assert np.abs(imaging.rectified(image, corners, 50, 80) - image).max() < 1e-6
    assert imaging.standardised(image).shape == (3, 256, 256) and imaging.line_tensor(image).shape[2] == 48
    tensors = imaging.liveness_tensors(image, [0.25, 0.2, 0.5, 0.6], side=32)
    assert len(tensors) == 7 and all(t.shape == (1, 3, 32, 32) for t in tensors) and 0 <= tensors[3].min() <= tensors[3].max() <= 1
    assert imaging.face_crop(image, [0.25, 0.2, 0.5, 0.6], 1.1, False).shape == (23, 23, 3) and imaging.face_crop(image, [0.0, 0.0, 1.0, 1.0], 1.45, True).shape == (50, 73, 3)


def test_configured_preprocessing(spark):
    image = np.zeros((100, 200, 3), np.uint8)
    image[20:80, 50:150] = [127, 64, 32]
    found = [{"kind": "kGenericDocument", "score": 0.9, "box": [50, 20, 150, 80]}, {"kind": "kGenericDocument", "score": 0.1, "box": [0, 0, 9, 9]}, {"kind": "kPhoto", "box": [60, 30, 100, 70]}]
    steps = [{"type": "align_document_by_bbox", "detection_to_use": "kGenericDocument", "pad_percentage": 0}, {"type": "resize", "target_width": 20, "target_height": 10, "interpolation_mode": "INTER_NEAREST"}, {"type": "normalize", "mean": [127, 64, 32], "std": [1, 2, 4]}]
    out = imaging.preprocessed(image, steps, found)
    assert out.shape == (10, 20, 3) and out.dtype == np.float32 and not out.any()
    stack = {"type": "stack_detections_by_bbox", "target_width": 16, "target_height": 12, "interpolation_mode": "INTER_NEAREST", "detections_to_align_by_bbox": [{"detection_to_use": "kGhostPhoto", "pad_percentage": 50}, {"detection_to_use": "kPhoto", "pad_percentage": 0}], "detections_required": False}
    both = imaging.preprocessed(image, [stack, {"type": "convert_to_float"}], found)
    assert both.shape == (12, 16, 2) and not both[..., 0].any() and np.allclose(both[..., 1], (127 + 64 + 32) / 3)
    assert imaging.preprocessed(image, [{"type": "align_document_by_bbox", "detection_to_use": "kPhoto", "pad_percentage": 50}], found).shape == (80, 80, 3)
    turned = imaging.preprocessed(image, [{"type": "lead_to_orientation"}], orientation="k90")
    assert turned.shape == (200, 100, 3)
    for steps, told in (([{"type": "blur"}], "blur"), ([{"type": "align_document_by_bbox", "detection_to_use": "kGhost"}], "kGhost"), ([stack | {"detections_required": True}], "kGhostPhoto"), ([{"type": "resize", "target_width": 1, "target_height": 1, "interpolation_mode": "X"}], "X")):
        with pytest.raises(ValueError, match=told):
            imaging.preprocessed(image, steps, found)
    calls = []
    config = {"model_name": "m", "nnet_input_name": "in", "nnet_output_name": "out", "preprocessors": [{"type": "convert_to_float"}], "output_thresholds": [0.2, 0.3]}
    got = imaging.configured(image, config, lambda *x: calls.append(x[:3]) or [[0.25, 0.25]])
    assert calls == [("m", "in", "out")] and got["input_shape"] == [100, 200, 3] and got["output_shape"] == [1, 2]
    with pytest.raises(ValueError, match="nnet_input_name"):
        imaging.configured(image, {"model_name": "m", "nnet_output_name": "o"}, None)
    df = spark.createDataFrame([(1, got["raw"], [0.2, 0.3]), (2, [0.5], [0.1, 0.2]), (3, [0.3], [0.3])], "k int, v array<double>, t array<double>")
    told = {r.k: r.x for r in df.select("k", imaging.threshold_results(F.col("v"), F.col("t")).alias("x")).collect()}
    assert [x.above for x in told[1]] == [True, False] and told[1][0].margin == pytest.approx(0.05) and told[2] is None and told[3][0].above


def test_zones_are_found(spark):
    page = np.full((650, 1000, 3), 255, np.uint8)
    for top in (500, 555):
        for left in range(60, 950, 20):
            page[top : top + 29, left : left + 11] = 0
    small = np.full((19, 60, 3), 255, np.uint8)
    rows = [(1, 650, 1000, bytearray(page.tobytes()), None, None), (2, 19, 60, bytearray(small.tobytes()), None, None), (3, 0, 0, None, None, None), (4, 650, 1000, bytearray(page.tobytes()), 0.9, 0.13)]
    df = spark.createDataFrame(rows, "k int, height int, width int, data binary, wr double, hr double")
    wanted = df.select(F.col("k").alias("image"), F.lit(2).alias("rows"), mrz.search_ratios(F.col("hr"), 2).alias("ratios"), F.col("wr").alias("width_ratio"), F.col("hr").alias("height_ratio"))
    got = {r.image: r.boxes for r in pixels.zones(imaging.gray_lines(df, "k"), wanted).collect()}
    left, top, right, bottom = got[1][0]
    assert left < 0.08 and right > 0.94 and 0.72 < top < 0.79 and 0.88 < bottom < 0.94 and len(got[1]) <= 2
    assert got[2] == got[3] == [] and got[4][0][1] > 0.7
    lines = spark.createDataFrame([(got[1][0],)], "z array<double>").select(mrz.line_bounds(F.col("z"), 2).alias("b")).first().b
    assert lines[0][1] < lines[0][3] and lines[1][1] < lines[0][3] + 0.05 and lines[0][1] < lines[1][1]


def test_pixels_are_read_red_first(spark, tmp_path):
    image = picture(7, 5, 1)
    (tmp_path / "a.png").write_bytes(imaging.png(image))
    (tmp_path / "b.png").write_bytes(b"no image")
    rows = {r.path.rsplit("/", 1)[-1]: r for r in images.pixels(spark, str(tmp_path)).collect()}
    a = rows["a.png"]
    assert (imaging.as_image(a.height, a.width, a.data) == image).all()
    assert "b.png" not in rows or rows["b.png"].data is None


def test_metadata(spark):
    tag = b"Adobe Photoshop\0"
    body = b"II*\0" + (8).to_bytes(4, "little") + (1).to_bytes(2, "little") + (305).to_bytes(2, "little") + (2).to_bytes(2, "little") + len(tag).to_bytes(4, "little") + (26).to_bytes(4, "little") + (0).to_bytes(4, "little") + tag
    df = spark.createDataFrame([(bytearray(b"\xff\xd8Exif\0\0" + body),), (bytearray(b"plain"),)], "content binary").select(imaging.metadata_software(F.col("content")).alias("s"))
    assert [(r.s, r.d) for r in df.select("s", imaging.metadata_decision(F.col("s")).alias("d")).collect()] == [("Adobe Photoshop", "review"), (None, "pass")]


def test_manifest(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.bin").write_bytes(b"one")
    (tmp_path / "sub" / "b.bin").write_bytes(b"two")
    noted = spark.createDataFrame(manifest.described(manifest.files(spark, str(tmp_path))).collect())
    assert {r.path for r in noted.collect()} == {"a.bin", "sub/b.bin"}
    assert manifest.first_mismatch(noted, manifest.described(manifest.files(spark, str(tmp_path)))) is None
    (tmp_path / "a.bin").write_bytes(b"eno")
    (tmp_path / "extra").write_bytes(b"x")
    assert manifest.first_mismatch(noted, manifest.described(manifest.files(spark, str(tmp_path)))) == "a.bin: sha256"


def test_uploads(spark):
    df = spark.createDataFrame([(bytearray(b"x"), "a.PNG"), (bytearray(b"x"), "noname"), (bytearray(b""), "a.jpg"), (bytearray(b"x" * 30), "a.jpg"), (bytearray(b"x"), "a.tar.gz")], "c binary, n string")
    told = df.select(images.upload_error(F.col("c"), F.col("n"), 20).alias("e"), images.suffix(F.col("n")).alias("s")).collect()
    assert [r.e for r in told] == [None, None, "empty_file", "file_too_large", "unsupported_media_type"] and [r.s for r in told] == [".png", ".jpg", ".jpg", ".jpg", ".gz"]


def test_evaluation_files(spark, tmp_path):
    path = tmp_path / "pairs.csv"
    path.write_bytes("﻿pairIdentifier,samePerson,score\na, YES ,0.9\nb,impostor,0.1\nc,maybe,0.5\nd,no,7\n".encode())
    rows = {r.pair_id: (r.same_person, r.score, r.error) for r in catalogs.evaluation_records(spark, str(path)).collect()}
    assert rows == {"a": (True, 0.9, None), "b": (False, 0.1, None), "c": (None, 0.5, "label"), "d": (False, 7.0, "score")}
    assert catalogs.input_mode(["samePerson", "score", "image1", "image2"]) == "score"
    with pytest.raises(ValueError):
        catalogs.input_mode(["score"])


def test_responses(spark):
    kind = T.StructType([T.StructField("name", T.StringType()), T.StructField("status", T.IntegerType()), T.StructField("checks", T.MapType(T.StringType(), T.BooleanType())), T.StructField("secret", T.StringType()), T.StructField("surname", T.StringType())])
    row = spark.createDataFrame([(("A", 0, {"x": False}, "no", ""),)], T.StructType([T.StructField("r", kind)]))
    said = json.loads(row.select(responses.envelope(responses.document(F.col("r"), kind)).alias("j")).first()["j"])
    assert said == {"status": "ok", "data": {"identity": {"name": "A"}, "validation": {"status": 0, "checks": {"x": False}}}}
    assert responses.boolean_option("Off", True) is False and responses.liveness_thresholds("0.2") == (0.2, 0.2) and responses.field_names_option("a, b,a") == ["a", "b"]
    for bad in (lambda: responses.boolean_option("perhaps"), lambda: responses.top_k_option(0), lambda: responses.threshold_option(2, 0.5), lambda: responses.liveness_thresholds(0.1, 0.2)):
        with pytest.raises(ValueError):
            bad()
    assert {f["name"]: f["available"] for f in responses.capabilities()["families"]}["heic"] is False


def test_streams(spark, tmp_path, sf_dir):
    source, out = tmp_path / "in", tmp_path / "out"
    spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("doc_id"), F.col("event_type").alias("format"), F.col("props").alias("text"), "ts").repartition(3).write.parquet(str(source))
    stream = ingest.first_symbols(ingest.files(spark, str(source), "doc_id long, format string, text string, ts timestamp", per_trigger=1), late="3650 days")
    ingest.write(stream, str(out), str(tmp_path / "check")).awaitTermination()
    want = spark.read.parquet(str(source)).dropDuplicates(["doc_id", "format", "text"]).count()
    assert spark.read.parquet(str(out)).count() == want


def test_document_response(spark):
    from attest.plans import projections

    barcodes_type = "array<struct<format:string,text:string>>"
    qr = "struct<credential_identifier:string,issue_date:string,credential_type:string,query_identifier:string,verification_url:string,barcode_number:string>"
    kind = f"doc_id int, document_name string, country string, document_number string, surname string, given_names string, date_of_birth string, source string, profile string, status int, mrz_code string, checks map<string,boolean>, engine string, capture string, machine_barcodes {barcodes_type}, ine_qr {qr}, visual_regions map<string,struct<box:array<double>,side:string>>, page_role struct<role:string,ordinal:int>"
    rows = [
        (1, "Passport", "Belarus", "AB123", "DOE", "JANE", "1990-01-01", "MRZ", "ICAO-TD3", 1, "LINE1\nLINE2", {"documentNumber": True}, "internal-model.onnx", "real", [], None, {}, ("primary_page", 1)),
        (2, "Voter Credential", "Mexico", "", "", "", "", "BARCODE", "MEX-INE-QR", 1, "", None, "x", None, [("QRCode", "https://u"), ("Code128", "77")], ("9", "2020-01-01", "X", "5", "https://u", "77"), {"portrait": ([0.0, 0.0, 1.0, 1.0], "front"), "barcode": ([0.0], None)}, None),
        (3, None, None, None, None, None, None, None, None, None, None, None, None, None, None, None, None, None),
    ]
    got = {r.doc_id: json.loads(r.response) for r in projections.answered(projections.document_response(spark.createDataFrame(rows, kind))).collect()}
    one, two, three = (got[k]["data"] for k in (1, 2, 3))
    assert got[1]["status"] == "ok" and one["document"]["number"] == "AB123" and one["document"]["pageRole"]["role"] == "primary_page"
    assert one["holder"] == {"name": "DOE JANE", "surname": "DOE", "givenNames": "JANE"} and one["dates"] == {"birth": "1990-01-01"}
    assert one["machineReadable"] == {"type": "TD3", "code": "LINE1\nLINE2", "checks": {"documentNumber": True}} and one["validation"] == {"structural": "valid", "spoofingDecision": "real"}
    assert not {"address", "identifiers", "details", "regions", "pairing"} & set(one) and "internal-model" not in json.dumps(got)
    assert two["machineReadable"]["type"] == "PDF417" and two["machineReadable"]["barcodes"] == [{"format": "Code128", "value": "77"}] and two["machineReadable"]["verification"]["verificationUrl"] == "https://u"
    assert two["identifiers"] == {"credentialIdentifier": "9", "queryIdentifier": "5", "barcodeNumber": "77"} and two["regions"] == {"portrait": {"box": [0.0, 0.0, 1.0, 1.0], "side": "front"}}
    assert three == {"document": {"recognized": False, "source": "NOT_AVAILABLE", "profile": "UNSUPPORTED"}, "validation": {"structural": "not_available"}}


def test_queries_against_all(spark):
    from attest.operators import search

    r = np.random.RandomState(1)
    vectors = [(k, [float(x) for x in r.randn(8).astype(np.float32)], int(r.randint(3))) for k in range(90)]
    vectors[5], vectors[20], vectors[7] = (5, None, 0), (20, [0.0] * 8, 1), (7, [1.0], 1)
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int")
    want = {}
    for a, x, p in vectors:
        for b, y, q in vectors:
            if a % 20 == 0 and a != b and (b % 20 or a < b) and x and y and len(y) == 8 and any(x) and any(y):
                x64, y64 = np.array(x, np.float32).astype(float), np.array(y, np.float32).astype(float)
                want[a, b] = (p == q, round(float(x64 @ y64 / np.sqrt((x64 @ x64) * (y64 @ y64)) + 1) / 2, 6))
    for block in (2, 1000):
        got = {(x.vec_id, x.other): (x.same_person, x.score) for x in search.pair_scores(df, block=block).collect()}
        assert got == want
        counted = {(x.same_person, x.score): x.n for x in search.score_counts(df, block=block).collect()}
        assert sum(counted.values()) == len(want) and set(counted) == set(want.values())
    records = spark.createDataFrame([(bool(a), float(s)) for a, s in want.values()], "same_person boolean, score double")
    points = lambda d: sorted(tuple(r) for r in evaluation.curve(d).collect())
    assert points(records) == points(search.score_counts(df))
    assert search.pair_scores(df.where("false")).count() == 0


def test_pairs_of_one_file_are_not_one_task(spark, tmp_path):
    """Work grows with the square of the rows: rows that are read as one piece are dealt out before they meet the queries."""
    from attest.operators import search

    r = np.random.RandomState(2)
    vectors = [(k, [float(x) for x in r.randn(4)], k % 3) for k in range(400)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(str(tmp_path / "v"))
    df = spark.read.parquet(str(tmp_path / "v"))
    assert df.rdd.getNumPartitions() == 1
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would be put together again
    try:
        by_task = [x["count"] for x in search.pair_scores(df).groupBy(F.spark_partition_id()).count().collect()]
        assert sum(by_task) == 20 * 399 - 190 and max(by_task) < sum(by_task) / 2
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_pairs_by_ranges_are_the_same_pairs(spark, monkeypatch):
    """Vectors that are equal, opposite, missing, zero, not finite, of another length, and scores on the borders of ranges."""
    from attest.operators import search

    r = np.random.RandomState(3)
    vectors = [(k - 40, [float(x) for x in r.randn(2).astype(np.float32)], int(r.randint(3))) for k in range(700)]
    for k, v in ((45, None), (60, [0.0, 0.0]), (47, [1.0]), (48, [float("nan"), 1.0]), (80, vectors[41][1]), (100, [-x for x in vectors[41][1]]), (49, [])):
        vectors[k] = (k - 40, v, 1)
    for n in range(1, search.RANGES):  # a query, and a vector whose score with it is the least of range n
        c = 2 * n * search.VALUES / 10**search.PLACES - 1
        vectors[300 + n] = (260 + n, [c, float(np.sqrt(1 - c * c))] if c < 1 else [1.0, 0.0], 0)
    vectors[120] = (80, [1.0, 0.0], 0)
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int")
    plain = search.pair_scores(df).collect()
    monkeypatch.setattr(search, "MANY", 1)
    monkeypatch.setattr(search, "PART", 300)
    monkeypatch.setattr(search, "HEAP", 20)
    assert len(plain) > 20000 and {x.score for x in plain} >= {0.0, 1.0} | {n * search.VALUES / 10**search.PLACES for n in range(1, search.RANGES)}
    for block in (7, 1000):
        ranged = search.pair_scores(df, block=block)
        assert sorted(ranged.collect()) == sorted(plain)
    assert search.pair_scores(df.where("vec_id % 20 <> 0")).count() == 0


def test_many_pairs_take_few_bytes(spark, tmp_path):
    """The result of all pairs fills disks: a file codes scores by a dictionary, where its scores are few enough. Every pair is there, once."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    from attest.operators import search

    n = 9500
    x = np.random.RandomState(4).randn(n, 64).astype(np.float32)
    table = pa.table({"vec_id": np.arange(n), "embedding": pa.ListArray.from_arrays(pa.array(np.arange(0, 64 * n + 1, 64), pa.int32()), pa.array(x.ravel())), "label": pa.array(np.arange(n) % 10, pa.int32())})
    pq.write_table(table, tmp_path / "v.parquet")
    search.pair_scores(spark.read.parquet(str(tmp_path / "v.parquet"))).write.parquet(str(tmp_path / "out"))
    got = pq.read_table(tmp_path / "out")
    a, b = got["vec_id"].to_numpy(), got["other"].to_numpy()
    unit = x.astype(float) / np.sqrt((x.astype(float) ** 2).sum(1, keepdims=True))
    assert len(a) == 475 * (n - 1) - 475 * 474 // 2 == len(np.unique(a * n + b)) and (a % 20 == 0).all() and ((b % 20 != 0) | (a < b)).all() and (a != b).all()
    assert np.abs(got["score"].to_numpy() - ((unit[::20] @ unit.T)[a // 20, b] + 1) / 2).max() < 5.1e-7
    assert (got["same_person"].to_numpy() == (a % 10 == b % 10)).all()
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 6 * len(a)


def test_places_of_groups(spark):
    r = np.random.RandomState(2)
    rows = [(g, float(v)) for g, n in (("a", 1), ("b", 2), ("c", 4999), (None, 700)) for v in (r.randint(0, 40, n) if g is None else r.rand(n) ** 9)] + [("a", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {x.g: (x.n, x.median, x.p95) for x in evaluation.nearest_rank(df, ["g"], "v").collect()}
    for g in ("a", "b", "c", None):
        own = sorted(v for k, v in rows if k == g and v is not None)
        assert got[g] == (len(own), pytest.approx(float(np.median(own))), own[round(0.95 * (len(own) - 1))])


def test_headers_of_files(spark, tmp_path):
    def tags(orientation, software=b"GIMP 2\0"):
        entries = [(274, 3, 1, orientation), (305, 2, len(software), 38)]
        body = b"II*\0" + (8).to_bytes(4, "little") + len(entries).to_bytes(2, "little")
        for tag, kind, count, value in entries:
            body += tag.to_bytes(2, "little") + kind.to_bytes(2, "little") + count.to_bytes(4, "little") + value.to_bytes(4, "little")
        return body + (0).to_bytes(4, "little") + software

    def chunk(kind, body):
        return len(body).to_bytes(4, "big") + kind + body + zlib.crc32(kind + body).to_bytes(4, "big")

    image = picture(4, 6, 2)
    plain = imaging.png(image)
    for turn in range(1, 9):
        marked = plain[:33] + chunk(b"iCCP", b"x\0\0" + zlib.compress(b"y")) * (turn == 2) + chunk(b"eXIf", tags(turn)) + plain[33:]
        (tmp_path / f"{turn}.png").write_bytes(marked)
    (tmp_path / "plain.png").write_bytes(plain)
    jpeg = b"\xff\xd8" + b"\xff\xe1" + (2 + 6 + len(tags(6))).to_bytes(2, "big") + b"Exif\0\0" + tags(6) + b"\xff\xe2" + (14).to_bytes(2, "big") + b"ICC_PROFILE\0" + b"\xff\xc0" + (9).to_bytes(2, "big") + b"\x08\x00\x10\x00\x20\x03\x00"
    df = spark.createDataFrame([("p", bytearray((tmp_path / "2.png").read_bytes())), ("j", bytearray(jpeg)), ("n", None), ("t", bytearray(b"text"))], "k string, content binary")
    got = {r.k: r.m for r in df.select("k", imaging.metadata("content").alias("m")).collect()}
    assert tuple(got["p"]) == ("PNG", 6, 4, True, True, "GIMP 2", 2) and tuple(got["j"]) == ("JPEG", 32, 16, True, True, "GIMP 2", 6)
    assert tuple(got["n"]) == tuple(got["t"]) == (None, None, None, False, False, None, 1)
    rows = {r.path.rsplit("/", 1)[-1]: r for r in images.upright_pixels(spark, str(tmp_path)).collect()}
    seen = {k: imaging.as_image(r.height, r.width, r.data) for k, r in rows.items()}
    turned = {1: image, 2: image[:, ::-1], 3: image[::-1, ::-1], 4: image[::-1], 5: image.transpose(1, 0, 2), 6: np.rot90(image, -1), 7: image.transpose(1, 0, 2)[::-1, ::-1], 8: np.rot90(image)}
    assert all((seen[f"{k}.png"] == v).all() for k, v in turned.items()) and (seen["plain.png"] == image).all()


def test_images_of_regions(spark):
    image = picture(20, 30, 4)
    sides = spark.createDataFrame([(1, "front", 20, 30, bytearray(image.tobytes()))], "doc_id int, side string, height int, width int, data binary")
    rows = [(1, "portrait", None, [0.1, 0.1, 0.5, 0.6]), (1, "signature", "front", [0.2, 0.2, 0.2, 0.9]), (1, "ghostPortrait", "back", [0.0, 0.0, 1.0, 1.0]), (1, "other", "front", [0.0, 0.0, 1.0, 1.0]), (1, "barcode", "front", [0.5]), (2, "portrait", "front", [0.0, 0.0, 1.0, 1.0])]
    got = imaging.extracted_images(spark.createDataFrame(rows, "doc_id int, name string, side string, box array<double>"), sides).collect()
    assert [(r.doc_id, r.type, r.side, r.width, r.height) for r in got] == [(1, "portrait", "front", 12, 10)]
    assert base64.b64decode(got[0].imageBase64) == imaging.png(image[2:12, 3:15])


def test_variants_of_a_text():
    image = picture(6, 9, 5) // 2 + 20
    assert (imaging.text_variant(image, 90, "original") == np.rot90(image)).all()
    hard = imaging.text_variant(image, 0, "catalog_contrast_normalization")
    assert hard.shape == image.shape and hard.min() == 0 and hard.max() == 255
    flat = np.full((3, 3, 3), 7, np.uint8)
    assert (imaging.text_variant(flat, 0, "catalog_contrast_normalization") == 7).all()
    with pytest.raises(ValueError, match="blur"):
        imaging.text_variant(image, 0, "blur")
