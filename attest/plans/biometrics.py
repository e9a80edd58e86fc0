"""Named queries over embeddings and events: templates, decisions, boxes, evaluation. SQL beside each where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import faces, policy, vectors
from ..operators import detection, evaluation, search
from ..sources.tables import table

#: Queries are the vectors whose id this divides; each is held against all vectors.
EVERY = 20
TARGETS = [0.0, 0.01, 0.1, 0.25, 0.5]


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.pair_scores(table(spark, sf_dir, "embeddings"), EVERY)


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs, counted by score."""
    return search.score_counts(table(spark, sf_dir, "embeddings"), EVERY)


_PAIRS = f"""
v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
pairs AS (SELECT a.vec_id, b.vec_id AS other, a.label = b.label AS same_person,
                 round((list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) + 1) / 2, 6) AS score
          FROM v a JOIN v b ON a.vec_id % {EVERY} = 0 AND a.vec_id <> b.vec_id AND (b.vec_id % {EVERY} <> 0 OR a.vec_id < b.vec_id))"""
_CURVE = f"""{_PAIRS},
t AS (SELECT count(*) FILTER (same_person) AS g, count(*) FILTER (NOT same_person) AS i FROM pairs),
s AS (SELECT score, count(*) FILTER (same_person) AS g, count(*) FILTER (NOT same_person) AS i FROM pairs GROUP BY score),
u AS (SELECT score, sum(g) OVER w AS g, sum(i) OVER w AS i, lead(score) OVER w AS below FROM s WINDOW w AS (ORDER BY score DESC)),
p AS (SELECT (score + below) / 2 AS threshold, g, i FROM u WHERE below IS NOT NULL
      UNION ALL SELECT 1.0, 0, 0
      UNION ALL SELECT 0.0, count(*) FILTER (same_person AND score > 0), count(*) FILTER (NOT same_person AND score > 0) FROM pairs),
curve AS (SELECT threshold, p.g::BIGINT AS true_accept, p.i::BIGINT AS false_accept, (t.g - p.g)::BIGINT AS false_reject, (t.i - p.i)::BIGINT AS true_reject,
                 p.i / t.i::DOUBLE AS far, 1 - p.g / t.g::DOUBLE AS frr, p.g / t.g::DOUBLE AS tar, 1 - p.i / t.i::DOUBLE AS trr FROM p, t)"""


def _rounded(df: DataFrame, *columns: str, places: int = 7) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


def operating_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluation.curve(counts(spark, sf_dir)), "threshold", "far", "frr", "tar", "trr")


def equal_error_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluation.equal_error(evaluation.curve(counts(spark, sf_dir))), "eer", "threshold", "far", "frr")


def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluation.auc(counts(spark, sf_dir)), "auc")


def target_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluation.at_targets(evaluation.curve(counts(spark, sf_dir)), TARGETS), "threshold", "far", "tar", "frr")


def score_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluation.summary(counts(spark, sf_dir)), "min", "max", "mean", "median", places=5)


def template_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).select("vec_id", "other", "score", policy.same_person(F.col("score")).alias("accepted"))


def template_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding")
    broken = F.when(F.col("vec_id") % 5 == 1, F.slice(e, 1, 63)).when(F.col("vec_id") % 5 == 2, F.transform(e, lambda x: F.lit(0.0).cast("float"))).when(F.col("vec_id") % 5 == 3, F.transform(e, lambda x, i: F.when(i == 7, F.lit(float("nan")).cast("float")).otherwise(x))).otherwise(e)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.coalesce(vectors.template_error(broken, 64), F.lit("valid")).alias("status"))


def template_wire(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode, decode: bytes on the wire, and whether the vector came back."""
    e = table(spark, sf_dir, "embeddings").withColumn("payload", faces.template_encode(F.col("embedding")))
    return e.select("vec_id", F.length("payload").alias("n_bytes"), (faces.template_decode(F.col("payload")) == F.col("embedding")).alias("same"))


def softmax_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    probabilities = vectors.softmax(F.slice("embedding", 1, 16))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(vectors.top_k(probabilities, 3)).alias("rank", "c"))
    return rows.select("vec_id", "rank", F.col("c.place").alias("place"), F.round("c.value", 6).alias("probability"))


LETTERS = "ABCDEFG"


def ctc_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector read as eight steps of eight classes, the last of which is the blank."""
    steps = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.slice(F.col("embedding"), k * 8 + 1, F.lit(8)))
    told = vectors.ctc_decode(steps, F.array(*map(F.lit, LETTERS)))
    return table(spark, sf_dir, "embeddings").select("vec_id", told.alias("t")).select("vec_id", "t.text", F.round("t.confidence", 6).alias("confidence"))


def liveness_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    logits = F.transform(F.slice("embedding", 1, 7), lambda x: x.cast("double") * 20 + 4)
    score = F.round(policy.ensemble_score(logits, list(policy.LIVENESS_WEIGHTS), policy.LIVENESS_BIAS), 6)
    rows = table(spark, sf_dir, "embeddings").select("vec_id", score.alias("score"))
    return rows.select("vec_id", "score", policy.liveness_decision(F.col("score"), F.col("vec_id") % 9 != 0).alias("decision"))


def verification_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda values, by: F.element_at(F.array(*(F.lit(x).cast("string") for x in values)), (F.floor(F.col("vec_id") / by) % len(values) + 1).cast("int"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", pick(("same_person", "different_person", "review"), 1).alias("identity"), pick(("real", "spoof", "review", None), 3).alias("liveness"), pick(("pass", "real", "review", "spoof", "not_available", None), 12).alias("capture"))
    return rows.select("*", policy.verification_decision(F.col("identity"), F.col("liveness"), F.col("capture")).alias("decision"))


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding")
    at = lambda k: F.round(F.abs(e[k].cast("double")) * 2, 4)
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.array(at(0), at(1), at(0) + at(2) + 0.05, at(1) + at(3) + 0.05).alias("box"), F.round(F.abs(e[4].cast("double")), 4).alias("score"))


_BOXES = """
b AS (SELECT vec_id, label, round(abs(embedding[1]::DOUBLE) * 2, 4) AS l, round(abs(embedding[2]::DOUBLE) * 2, 4) AS t, round(abs(embedding[3]::DOUBLE) * 2, 4) AS w, round(abs(embedding[4]::DOUBLE) * 2, 4) AS h,
             round(abs(embedding[5]::DOUBLE), 4) AS score FROM embeddings),
boxes AS (SELECT vec_id, label, l, t, l + w + 0.05::DOUBLE AS r, t + h + 0.05::DOUBLE AS d, score FROM b)"""


def box_nms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of 24 detections each."""
    b = _boxes(spark, sf_dir).groupBy(F.floor(F.col("vec_id") / 24).alias("image")).agg(F.collect_list(F.struct("score", F.col("vec_id").alias("seq"), "box")).alias("d"))
    return b.select("image", F.explode(faces.suppressed(F.col("d"), 0.3)).alias("k")).select("image", F.col("k.seq").alias("vec_id"), F.col("k.score").alias("score"))


def box_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = faces.pixel_box(F.col("box"), F.lit(640), F.lit(480))
    return _boxes(spark, sf_dir).select("vec_id", p[0].alias("left"), p[1].alias("top"), p[2].alias("right"), p[3].alias("bottom"))


def box_to_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    corners = F.array(*(F.array(F.lit(float(x)), F.lit(float(y))) for x, y in ((100, 50), (900, 80), (880, 560), (120, 600))))
    s = faces.source_box(faces.clipped(F.col("box")), corners, F.lit(1000.0), F.lit(700.0), (F.col("vec_id") % 4).cast("int") * 90)
    return _boxes(spark, sf_dir).select("vec_id", *(F.round(s[k], 6).alias(n) for k, n in enumerate(("left", "top", "right", "bottom"))))


def face_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _boxes(spark, sf_dir).select("vec_id", faces.plausible_face(F.col("box"), F.col("score") * 8).alias("plausible"))


def face_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding")
    angle = lambda k: F.round(e[k].cast("double") * 150, 3)
    b = _boxes(spark, sf_dir).join(table(spark, sf_dir, "embeddings").select("vec_id", angle(5).alias("yaw"), angle(6).alias("pitch"), angle(7).alias("roll")), "vec_id")
    w = faces.quality_warnings(faces.clipped(F.col("box")), F.lit(400), F.lit(400), F.col("yaw"), F.col("pitch"), F.col("roll"), F.col("label") % 3, F.col("score") * 5)
    return b.select("vec_id", F.array_join(F.transform(w, lambda x: x["code"]), ",").alias("warnings"), F.when(F.size(w) > 0, "review").otherwise("pass").alias("status"), faces.liveness_eligible(w).alias("eligible"))


def ssd_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(faces.anchors(spark), "cy", "cx", "h", "w")


def ssd_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four numbers of a vector as the encoding of the anchor of its id."""
    met = table(spark, sf_dir, "embeddings").withColumn("anchor", (F.col("vec_id") % 5118).cast("int")).join(F.broadcast(faces.anchors(spark)), "anchor")  # 5118 rows
    box = faces.decoded_box(F.transform(F.slice("embedding", 1, 4), lambda x: x.cast("double") * 10), F.col("cy"), F.col("cx"), F.col("h"), F.col("w"))
    return met.select("vec_id", *(F.round(box[k], 6).alias(n) for k, n in enumerate(("left", "top", "right", "bottom"))))


def _outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as outputs of a detector at anchors of the coarser maps, eight to an image."""
    at = lambda k, by: F.round(F.col("embedding")[k].cast("double") * by, 6)
    return table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 8).alias("image"), (5017 + F.col("vec_id") * 7 % 101).cast("int").alias("anchor"), F.round(F.abs(at(4, 5.0)), 6).alias("score"), F.array(at(0, 5.0), at(1, 5.0), at(2, 5.0), at(3, 5.0)).alias("code"))


def face_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From raw outputs to faces with their quality: an image's faces, the surest first; every third has no pose."""
    found = detection.found_faces(_outputs(spark, sf_dir).dropDuplicates(["image", "anchor"]))
    poses = found.where((F.col("image") + F.col("place")) % 3 > 0).select("image", "place", (F.col("image") % 50).cast("double").alias("yaw"), F.lit(0.0).alias("pitch"), F.lit(0.0).alias("roll"), F.lit(0.1).alias("covered"))
    rows = detection.analysed_faces(found, poses, F.lit(400), F.lit(300))
    b = F.col("box")
    return rows.select("image", "place", "faces", "score", *(F.round(b[k], 6).alias(n) for k, n in enumerate(("left", "top", "right", "bottom"))), F.array_join("warnings", ",").alias("warnings"), "status", F.col("eligible").cast("int").alias("eligible"))


def image_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as measurements of images: some without the screen models."""
    e = F.col("embedding")
    at = lambda k: F.round(e[k].cast("double"), 4)
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image"), at(3).alias("focus"), F.when(F.col("vec_id") % 3 > 0, F.array(at(0), at(1), at(2))).alias("electronic"), F.when(F.col("vec_id") % 5 > 0, F.round(F.abs(e[4].cast("double")) * 5, 4)).alias("moire"))
    return detection.analysed_quality(rows).withColumn("document_pad", F.col("document_pad").cast("int"))


def detection_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surest detection of each kind."""
    b = _boxes(spark, sf_dir)
    return b.groupBy("label").agg(F.max_by(F.struct("vec_id", "score"), F.struct("score", -F.col("vec_id"))).alias("b")).select("label", "b.*")


def document_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of eight detections: too many documents, too little room at the edge."""
    image = F.floor(F.col("vec_id") / 8)
    b = _boxes(spark, sf_dir).withColumns({"image": image, "n": F.count("*").over(Window.partitionBy(image))})
    room = F.least(F.col("box")[0], F.col("box")[1], 1 - F.col("box")[2], 1 - F.col("box")[3])
    return b.select("image", "vec_id", (F.col("n") > 7).alias("too_many_documents"), (F.round(room, 4) < 0.05).alias("insufficient_document_padding"))


def liveness_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _boxes(spark, sf_dir).withColumns({"p": F.least(F.col("score") * 5, F.lit(1.0)), "status": F.when(F.col("vec_id") % 11 == 0, "document_too_small")})
    return b.select("vec_id", policy.document_liveness(F.col("p"), F.col("status")).alias("decision"))


def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluation.nearest_rank(table(spark, sf_dir, "events"), ["event_type"], "value"), "median", "p95", places=6)


def capture_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sides of a document: a user's events of one day, their type told as a decision. Each decision is counted first, so that no list grows with the events."""
    kinds = {"click": "pass", "view": "real", "purchase": "not_available", "signup": "review", "logout": "spoof"}
    said = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for p in kinds.items() for x in p)), F.col("event_type")), F.lit("not_available"))
    rows = table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").cast("string").alias("day")).agg(F.collect_set(said).alias("decisions"))
    return rows.select("user_id", "day", policy.capture_decision(F.col("decisions")).alias("decision"))


_ANGLE = "round(embedding[{k}]::DOUBLE * 150, 3)"
_CLIP = "least(greatest({x}, 0.0), 1.0)"

_ANCHORS = """
m AS (SELECT unnest([0, 1, 2, 3, 4, 5]) AS m, unnest({maps}) AS n),
z AS (SELECT m, n, CASE WHEN m = 5 THEN 0.95 ELSE 0.2 + 0.15 * m END AS a, CASE WHEN m = 5 THEN 1.0 ELSE 0.35 + 0.15 * m END AS b FROM m),
k AS (SELECT m, n, unnest(CASE WHEN m = 0 THEN [0, 1, 2] ELSE [0, 1, 2, 3, 4, 5] END) AS k,
             unnest(CASE WHEN m = 0 THEN [0.1, 0.2 / sqrt(2), 0.2 * sqrt(2)] ELSE [a, sqrt(a * b), a / sqrt(2.0), a / sqrt(0.5), a / sqrt(3.0), a / sqrt(1.0::DOUBLE / 3)] END) AS h,
             unnest(CASE WHEN m = 0 THEN [0.1, 0.2 * sqrt(2), 0.2 / sqrt(2)] ELSE [a, sqrt(a * b), a * sqrt(2.0), a * sqrt(0.5), a * sqrt(3.0), a * sqrt(1.0::DOUBLE / 3)] END) AS w FROM z),
c AS (SELECT m, n, k, h, w, unnest(range(n)) AS y FROM k), g AS (SELECT m, n, k, h, w, y, unnest(range(n)) AS x FROM c),
anchors AS (SELECT (row_number() OVER (ORDER BY m, y, x, k) - 1)::INT AS anchor, (y + 0.5::DOUBLE) / n AS cy, (x + 0.5::DOUBLE) / n AS cx, h, w FROM g)""".format(maps=list(faces.MAPS))

QUERIES = {f.__name__: f for f in (operating_points, equal_error_rate, roc_auc, target_points, score_summary, template_compare, template_validate, template_wire, softmax_topk, ctc_decode, liveness_policy, verification_policy, box_nms, box_pixels, box_to_source, face_filter, face_quality, ssd_anchors, ssd_decode, face_detections, image_quality, detection_by_kind, document_geometry, liveness_contract, latency_percentiles, capture_decision)}

ORACLES = {
    "operating_points": f"WITH {_CURVE} SELECT round(threshold, 7) AS threshold, true_accept, false_accept, false_reject, true_reject, round(far, 7) AS far, round(frr, 7) AS frr, round(tar, 7) AS tar, round(trr, 7) AS trr FROM curve",
    "equal_error_rate": f"WITH {_CURVE} SELECT round((far + frr) / 2, 7) AS eer, round(threshold, 7) AS threshold, round(far, 7) AS far, round(frr, 7) AS frr FROM curve ORDER BY abs(far - frr), far + frr, threshold DESC LIMIT 1",
    "roc_auc": f"""WITH {_CURVE}, r AS (SELECT DISTINCT far, tar FROM curve UNION SELECT 0.0, 0.0 UNION SELECT 1.0, 1.0),
        z AS (SELECT far, tar, lag(far) OVER (ORDER BY far, tar) AS x, lag(tar) OVER (ORDER BY far, tar) AS y FROM r) SELECT round(sum((far - x) * (tar + y) / 2), 7) AS auc FROM z""",
    "target_points": f"""WITH {_CURVE}, z AS (SELECT target, threshold, far, tar, frr, row_number() OVER (PARTITION BY target ORDER BY tar DESC, far DESC, threshold) AS k
        FROM curve, (SELECT unnest({TARGETS})::DOUBLE AS target) WHERE far <= target) SELECT target, round(threshold, 7) AS threshold, round(far, 7) AS far, round(tar, 7) AS tar, round(frr, 7) AS frr FROM z WHERE k = 1""",
    "score_summary": f"WITH {_PAIRS} SELECT same_person, count(*) AS count, round(min(score), 5) AS min, round(max(score), 5) AS max, round(avg(score), 5) AS mean, round(median(score), 5) AS median FROM pairs GROUP BY same_person",
    "template_compare": f"WITH {_PAIRS} SELECT vec_id, other, score, score > 0.67 AS accepted FROM pairs",
    "template_validate": "SELECT vec_id, CASE vec_id % 5 WHEN 1 THEN 'length' WHEN 2 THEN 'zero_norm' WHEN 3 THEN 'not_finite' ELSE 'valid' END AS status FROM embeddings",
    "template_wire": "SELECT vec_id, 4 * len(embedding) AS n_bytes, true AS same FROM embeddings",
    "softmax_topk": """WITH e AS (SELECT vec_id, unnest(range(0, 16)) AS place, embedding FROM embeddings), x AS (SELECT vec_id, place, exp(embedding[place + 1]::DOUBLE) AS v FROM e),
        p AS (SELECT vec_id, place, v / sum(v) OVER (PARTITION BY vec_id) AS p, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, place) - 1 AS rank FROM x)
        SELECT vec_id, rank, place, round(p, 6) AS probability FROM p WHERE rank < 3""",
    "ctc_decode": f"""WITH e AS (SELECT vec_id, unnest(range(0, 8)) AS step, embedding FROM embeddings), s AS (SELECT vec_id, step, embedding[step * 8 + 1:step * 8 + 8] AS c FROM e),
        k AS (SELECT vec_id, step, list_position(c, list_max(c)) - 1 AS k, list_max(c)::DOUBLE AS p FROM s), l AS (SELECT *, lag(k) OVER (PARTITION BY vec_id ORDER BY step) AS before FROM k),
        m AS (SELECT * FROM l WHERE k IS DISTINCT FROM before AND k <> 7)
        SELECT e.vec_id, coalesce(string_agg(substr('{LETTERS}', (k + 1)::INT, 1), '' ORDER BY m.step), '') AS text, coalesce(round(avg(p), 6), 0.0) AS confidence FROM embeddings e LEFT JOIN m USING (vec_id) GROUP BY e.vec_id""",
    "liveness_policy": f"""WITH s AS (SELECT vec_id, {" + ".join(f"(embedding[{k}]::DOUBLE * 20 + 4) * {w}" for k, w in enumerate(policy.LIVENESS_WEIGHTS, 1))} + {policy.LIVENESS_BIAS} AS s FROM embeddings),
        p AS (SELECT vec_id, round(least(greatest(0.5 + 0.5 * (s + 0.2) / CASE WHEN s > 0 THEN 3.0 ELSE 7.0 END, 0.0), 1.0), 6) AS score FROM s)
        SELECT vec_id, score, CASE WHEN vec_id % 9 = 0 THEN 'review' WHEN score > 0.37 THEN 'real' WHEN score <= 0.25 THEN 'spoof' ELSE 'review' END AS decision FROM p""",
    "verification_policy": """WITH r AS (SELECT vec_id, ['same_person', 'different_person', 'review'][vec_id % 3 + 1] AS identity, ['real', 'spoof', 'review', NULL][(vec_id // 3) % 4 + 1] AS liveness,
        ['pass', 'real', 'review', 'spoof', 'not_available', NULL][(vec_id // 12) % 6 + 1] AS capture FROM embeddings)
        SELECT *, CASE WHEN identity = 'different_person' OR liveness = 'spoof' THEN 'fail' WHEN capture IN ('review', 'spoof') THEN 'review' WHEN liveness IS NULL THEN 'not_available'
          WHEN capture IS NULL OR capture = 'not_available' THEN 'review' WHEN identity = 'same_person' AND liveness = 'real' THEN 'pass' ELSE 'review' END AS decision FROM r""",
    "face_detections": f"""WITH RECURSIVE {_ANCHORS}, e AS (SELECT vec_id // 8 AS image, (5017 + vec_id * 7 % 101)::INT AS anchor, round(abs(round(embedding[5]::DOUBLE * 5, 6)), 6) AS score, [round(x::DOUBLE * 5, 6) for x in embedding[1:4]] AS c FROM embeddings),
        d AS (SELECT image, anchor, score, c[1] / 10 * h + cy AS y, c[2] / 10 * w + cx AS x, exp(c[3] / 5) * h AS bh, exp(c[4] / 5) * w AS bw FROM e JOIN anchors USING (anchor) WHERE score >= 0.5),
        b AS (SELECT image, anchor, score, least(greatest(x - bw / 2, 0), 1) AS l, least(greatest(y - bh / 2, 0), 1) AS t, least(greatest(x + bw / 2, 0), 1) AS r, least(greatest(y + bh / 2, 0), 1) AS d FROM d),
        o AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY score DESC, anchor) AS k FROM b WHERE r - l >= 0.08 AND d - t >= 0.08 AND (r - l) / (d - t) BETWEEN 0.5 AND 1.5),
        s AS (SELECT image, 0::BIGINT AS k, []::STRUCT(n BIGINT, score DOUBLE, l DOUBLE, t DOUBLE, r DOUBLE, d DOUBLE)[] AS kept FROM o GROUP BY image
          UNION ALL SELECT s.image, o.k, CASE WHEN len(list_filter(kept, lambda q: greatest(least(q.r, o.r) - greatest(q.l, o.l), 0) * greatest(least(q.d, o.d) - greatest(q.t, o.t), 0)
            > 0.3 * ((q.r - q.l) * (q.d - q.t) + (o.r - o.l) * (o.d - o.t) - greatest(least(q.r, o.r) - greatest(q.l, o.l), 0) * greatest(least(q.d, o.d) - greatest(q.t, o.t), 0)))) > 0 THEN kept
            ELSE list_append(kept, {{'n': len(kept), 'score': o.score, 'l': o.l, 't': o.t, 'r': o.r, 'd': o.d}}) END FROM s JOIN o ON s.image = o.image AND o.k = s.k + 1),
        fin AS (SELECT image, arg_max(kept, k) AS kept FROM s GROUP BY image), f AS (SELECT image, len(kept) AS faces, unnest(kept) AS x FROM fin),
        q AS (SELECT image, x.n::INT AS place, faces, x.*, (image + x.n) % 3 > 0 AS posed, image % 50 > 35 AS turned FROM f),
        w AS (SELECT *, list_filter([CASE WHEN faces > 1 THEN 'MULTIPLE_FACES' END, CASE WHEN least((r - l) * 400, (d - t) * 300) < 80 OR least(r - l, d - t) < 0.12 THEN 'FACE_TOO_SMALL' END, CASE WHEN l <= 0.01 OR t <= 0.01 OR r >= 0.99 OR d >= 0.99 THEN 'FACE_CUTOFF' END, CASE WHEN turned THEN 'EXCESSIVE_POSE' END], lambda v: v IS NOT NULL) AS w FROM q)
        SELECT image, place, faces, score, round(l, 6) AS "left", round(t, 6) AS top, round(r, 6) AS "right", round(d, 6) AS bottom, CASE WHEN posed THEN array_to_string(w, ',') END AS warnings, CASE WHEN posed THEN CASE WHEN len(w) > 0 THEN 'review' ELSE 'pass' END END AS status, CASE WHEN posed THEN (NOT list_has_any(w, ['MULTIPLE_FACES', 'FACE_TOO_SMALL', 'FACE_CUTOFF']))::INT END AS eligible FROM w""",
    "image_quality": """WITH m AS (SELECT vec_id AS image, round(embedding[4]::DOUBLE, 4) AS focus, CASE WHEN vec_id % 3 > 0 THEN [round(x::DOUBLE, 4) for x in embedding[1:3]] END AS e, CASE WHEN vec_id % 5 > 0 THEN round(abs(embedding[5]::DOUBLE) * 5, 4) END AS moire FROM embeddings), r AS (SELECT *, e IS NOT NULL AND moire IS NOT NULL AS ran FROM m)
        SELECT image, focus, CASE WHEN NOT ran THEN 'not_available' WHEN e[1] >= e[2] AND e[1] >= e[3] AND moire <= 0.529 THEN 'pass' ELSE 'review' END AS spoofing_decision, 'not_available' AS liveness_decision, ran::INT AS document_pad, CASE WHEN NOT ran THEN 'document-capture models were not run' END AS reason FROM r""",
    "ssd_anchors": f"WITH {_ANCHORS} SELECT anchor, round(cy, 7) AS cy, round(cx, 7) AS cx, round(h, 7) AS h, round(w, 7) AS w FROM anchors",
    "ssd_decode": f"""WITH {_ANCHORS}, e AS (SELECT vec_id, (vec_id % 5118)::INT AS anchor, [x::DOUBLE * 10 for x in embedding[1:4]] AS c FROM embeddings),
        b AS (SELECT vec_id, c[1] / 10 * h + cy AS y, c[2] / 10 * w + cx AS x, exp(c[3] / 5) * h AS bh, exp(c[4] / 5) * w AS bw FROM e JOIN anchors USING (anchor))
        SELECT vec_id, round(x - bw / 2, 6) AS "left", round(y - bh / 2, 6) AS top, round(x + bw / 2, 6) AS "right", round(y + bh / 2, 6) AS bottom FROM b""",
    "box_nms": f"""WITH RECURSIVE {_BOXES}, o AS (SELECT vec_id // 24 AS image, vec_id, score, l, t, r, d, row_number() OVER (PARTITION BY vec_id // 24 ORDER BY score DESC, vec_id) AS k FROM boxes),
        s AS (SELECT image, 0::BIGINT AS k, []::STRUCT(vec_id BIGINT, score DOUBLE, l DOUBLE, t DOUBLE, r DOUBLE, d DOUBLE)[] AS kept FROM o GROUP BY image
          UNION ALL SELECT s.image, o.k, CASE WHEN len(list_filter(kept, lambda q: greatest(least(q.r, o.r) - greatest(q.l, o.l), 0) * greatest(least(q.d, o.d) - greatest(q.t, o.t), 0)
            > 0.3 * ((q.r - q.l) * (q.d - q.t) + (o.r - o.l) * (o.d - o.t) - greatest(least(q.r, o.r) - greatest(q.l, o.l), 0) * greatest(least(q.d, o.d) - greatest(q.t, o.t), 0)))) > 0 THEN kept
            ELSE list_append(kept, {{'vec_id': o.vec_id, 'score': o.score, 'l': o.l, 't': o.t, 'r': o.r, 'd': o.d}}) END FROM s JOIN o ON s.image = o.image AND o.k = s.k + 1),
        f AS (SELECT image, unnest(arg_max(kept, k)) AS x FROM s GROUP BY image) SELECT image, x.vec_id AS vec_id, x.score AS score FROM f""",
    "box_pixels": f"WITH {_BOXES} SELECT vec_id, {', '.join(f'least(greatest(round_even({x} * {s}, 0), 0), {s})::INT AS {n}' for x, s, n in (('l', 640, '\"left\"'), ('t', 480, 'top'), ('r', 640, '\"right\"'), ('d', 480, 'bottom')))} FROM boxes",
    "box_to_source": f"""WITH {_BOXES}, c AS (SELECT vec_id, vec_id % 4 AS q, {', '.join(f'{_CLIP.format(x=x)} AS {x}' for x in 'ltrd')} FROM boxes),
        q AS (SELECT vec_id, CASE q WHEN 0 THEN l WHEN 1 THEN 1 - d WHEN 2 THEN 1 - r ELSE t END AS l, CASE q WHEN 0 THEN t WHEN 1 THEN l WHEN 2 THEN 1 - d ELSE 1 - r END AS t,
                     CASE q WHEN 0 THEN r WHEN 1 THEN 1 - t WHEN 2 THEN 1 - l ELSE d END AS r, CASE q WHEN 0 THEN d WHEN 1 THEN r WHEN 2 THEN 1 - t ELSE 1 - l END AS d FROM c),
        p AS (SELECT vec_id, unnest([l, r, r, l]) AS x, unnest([t, t, d, d]) AS y FROM q),
        m AS (SELECT vec_id, ((1 - x) * (1 - y) * 100 + x * (1 - y) * 900 + x * y * 880 + (1 - x) * y * 120) / 1000 AS u, ((1 - x) * (1 - y) * 50 + x * (1 - y) * 80 + x * y * 560 + (1 - x) * y * 600) / 700 AS v FROM p)
        SELECT vec_id, round(least(greatest(min(u), 0.0), 1.0), 6) AS "left", round(least(greatest(min(v), 0.0), 1.0), 6) AS top, round(least(greatest(max(u), 0.0), 1.0), 6) AS "right", round(least(greatest(max(v), 0.0), 1.0), 6) AS bottom FROM m GROUP BY vec_id""",
    "face_filter": f"WITH {_BOXES} SELECT vec_id, score * 8 >= 0.5 AND r - l >= 0.08 AND d - t >= 0.08 AND (r - l) / (d - t) BETWEEN 0.5 AND 1.5 AS plausible FROM boxes",
    "face_quality": f"""WITH {_BOXES}, c AS (SELECT vec_id, label, score, {', '.join(f'{_CLIP.format(x=x)} AS {x}' for x in 'ltrd')} FROM boxes),
        q AS (SELECT c.*, {', '.join(f'{_ANGLE.format(k=k)} AS {n}' for k, n in ((6, 'yaw'), (7, 'pitch'), (8, 'roll')))} FROM c JOIN embeddings USING (vec_id)),
        w AS (SELECT vec_id, list_filter([CASE WHEN label % 3 > 1 THEN 'MULTIPLE_FACES' END, CASE WHEN least((r - l) * 400, (d - t) * 400) < 80 OR least(r - l, d - t) < 0.12 THEN 'FACE_TOO_SMALL' END,
          CASE WHEN l <= 0.01 OR t <= 0.01 OR r >= 0.99 OR d >= 0.99 THEN 'FACE_CUTOFF' END, CASE WHEN abs(yaw) > 35 OR abs(pitch) > 35 OR abs(roll) > 30 THEN 'EXCESSIVE_POSE' END, CASE WHEN score * 5 >= 0.8 THEN 'COVERED_FACE' END], lambda x: x IS NOT NULL) AS w FROM q)
        SELECT vec_id, array_to_string(w, ',') AS warnings, CASE WHEN len(w) > 0 THEN 'review' ELSE 'pass' END AS status, NOT list_has_any(w, ['MULTIPLE_FACES', 'FACE_TOO_SMALL', 'FACE_CUTOFF']) AS eligible FROM w""",
    "detection_by_kind": f"WITH {_BOXES}, z AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS k FROM boxes) SELECT label, vec_id, score FROM z WHERE k = 1",
    "document_geometry": f"WITH {_BOXES} SELECT vec_id // 8 AS image, vec_id, count(*) OVER (PARTITION BY vec_id // 8) > 7 AS too_many_documents, round(least(l, t, 1 - r, 1 - d), 4) < 0.05 AS insufficient_document_padding FROM boxes",
    "liveness_contract": f"WITH {_BOXES} SELECT vec_id, CASE WHEN vec_id % 11 = 0 THEN 'not_available' WHEN least(score * 5, 1.0) > 0.5 THEN 'live' ELSE 'spoof' END AS decision FROM boxes",
    "latency_percentiles": """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events)
        SELECT event_type, n, round(median(value), 6) AS median, round(max(value) FILTER (k = round_even(0.95 * (n - 1), 0)), 6) AS p95 FROM r GROUP BY event_type, n""",
    "capture_decision": """WITH d AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, CASE event_type WHEN 'click' THEN 'pass' WHEN 'view' THEN 'real' WHEN 'signup' THEN 'review' WHEN 'logout' THEN 'spoof' ELSE 'not_available' END AS x FROM events)
        SELECT user_id, day, CASE WHEN bool_or(x IN ('review', 'spoof')) THEN 'review' WHEN bool_or(x IN ('pass', 'real')) THEN 'pass' ELSE 'not_available' END AS decision FROM d GROUP BY user_id, day""",
}
