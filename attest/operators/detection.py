"""From a detector's raw outputs to the faces of an image, and from an image's measurements to its quality, as set-based steps.

Inference stays outside: its outputs come as rows (see observe).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import faces
from .imaging import capture_pad

#: How sure a detection must be, and how much two may overlap.
SURE, OVERLAP = 0.5, 0.3


def found_faces(outputs: DataFrame, least: float = SURE, overlap: float = OVERLAP) -> DataFrame:
    """image, place (from 0, the surest first), score, box: outputs are (image, anchor, score, code of four numbers).

    Codes are decoded against their anchors, boxes cut at the image's edge, implausible ones (too small, too narrow or wide) dropped; of those
    that overlap the surest stays, the lower anchor first. An image without a face has no row. An image has at most as many
    detections as there are anchors.
    """
    spark = outputs.sparkSession
    met = outputs.where(F.col("score") >= least).join(F.broadcast(faces.anchors(spark)), "anchor")  # 5118 anchors
    box = faces.clipped(faces.decoded_box(F.col("code"), F.col("cy"), F.col("cx"), F.col("h"), F.col("w")))
    met = met.withColumn("box", box).where(faces.plausible_face(F.col("box"), F.col("score")))
    held = met.select("image", F.struct("score", F.col("anchor").cast("long").alias("seq"), "box").alias("d")).groupBy("image").agg(F.collect_list("d").alias("d"))
    kept = held.select("image", F.posexplode(faces.suppressed(F.col("d"), overlap)).alias("place", "k"))
    return kept.select("image", "place", F.col("k.score").alias("score"), F.col("k.box").alias("box"))


def analysed_faces(found: DataFrame, poses: DataFrame, width: Column, height: Column) -> DataFrame:
    """found_faces() with what can be said of each: its box in pixels, the number of faces, and, for a face with a pose, warnings, quality status and whether it may be tested for liveness.

    poses: image, place, yaw, pitch, roll, covered (the landmark model's score), for faces that it has seen.
    """
    many = found.groupBy("image").agg(F.count("*").alias("faces"))
    rows = found.join(many, "image").join(poses.withColumn("posed", F.lit(True)), ["image", "place"], "left")
    warnings = F.when(F.col("posed"), faces.quality_warnings(F.col("box"), width, height, F.col("yaw"), F.col("pitch"), F.col("roll"), F.col("faces"), F.col("covered")))
    rows = rows.withColumn("warnings", warnings)
    status = F.when(F.size("warnings") > 0, "review").when(F.size("warnings") == 0, "pass")
    return rows.select("image", "place", "faces", "score", "box", faces.pixel_box(F.col("box"), width, height).alias("pixels"), F.transform("warnings", lambda w: w["code"]).alias("warnings"), status.alias("status"), faces.liveness_eligible(F.col("warnings")).alias("eligible"))


def analysed_quality(images: DataFrame) -> DataFrame:
    """image, focus, spoofing_decision, liveness_decision, document_pad, reason, from its measurements: focus, electronic (scores of the screen model) and moire.

    Focus is a signal of the capture and never a decision. Where the screen models were not run, the spoofing decision is not available, and the
    reason says so; a still image tells nothing of a live face.
    """
    ran = F.col("electronic").isNotNull() & F.col("moire").isNotNull()
    return images.select("image", "focus", capture_pad(F.col("electronic"), F.col("moire")).alias("spoofing_decision"), F.lit("not_available").alias("liveness_decision"), ran.alias("document_pad"), F.when(~ran, "document-capture models were not run").alias("reason"))
