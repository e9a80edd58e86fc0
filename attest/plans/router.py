"""The routing of one document image, as one CASE over what was observed of it.

Costs fall on what must be observed, so observations come in stages: `pending` gives the documents that a stage is still needed
for. A stage's rows are joined to what is known, and the route is told again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.barcodes import scan_pdf417
from ..sources.tables import forget, written

PROFILES = ("auto_research", "aamva_pdf417", "mex_ine", "mex_passport", "swe_id_2021", "icao_td1", "icao_td2", "icao_td3", "icao_mrv")
#: What each two-line profile takes; the automatic one takes all, in this order.
TWO_LINE = {"mrv": ("icao_mrv",), "td2": ("icao_td2",), "td3": ("mex_passport", "icao_td3")}
VALID_CHECKS = {"mrv": 3, "td2": 4, "td3": 5}
#: Observed columns with the value that an observation not yet made counts as.
OBSERVED = {"aamva_valid": False, "td1_shaped": False, "mrv_checks": 0, "td2_checks": 0, "td3_checks": 0, "ine_accepted": False, "swe_accepted": False, "ine_qr": False, "catalog_evidence": False}
STAGES = ("barcodes", "td1", "two_line", "visual", "catalog")


#: Stated profiles that a TD1 zone is not looked for with.
NO_TD1 = ("mex_passport", "icao_td2", "icao_td3", "icao_mrv", "swe_id_2021")


def td1_wanted(profile: Column) -> Column:
    return ~profile.isin(*NO_TD1)


def route(seen: DataFrame) -> Column:
    """aamva, td1, mrv, td2, td3, ine, swe, ine_qr, catalog, unsupported; rejected where a stated profile is not met.

    seen: profile, columns of OBSERVED, and optionally layout_hint and mrz_hint. A TD1 is taken for its shape, the two-line zones
    only if all their checks hold.
    """
    have = set(seen.columns)
    c = {k: F.coalesce(F.col(k), F.lit(v)) if k in have else F.lit(v) for k, v in OBSERVED.items()}
    hint = {k: F.col(k) if k in have else F.lit(None).cast("string") for k in ("layout_hint", "mrz_hint")}
    profile = F.col("profile")
    automatic = profile == "auto_research"
    told = F.when(c["aamva_valid"] & scan_pdf417(profile, hint["layout_hint"], hint["mrz_hint"]), "aamva").when(profile == "aamva_pdf417", "rejected")
    told = told.when(c["td1_shaped"] & profile.isin("mex_ine", "icao_td1", "auto_research"), "td1").when(profile == "icao_td1", "rejected").when(profile == "mex_ine", "ine")
    told = told.when(profile == "swe_id_2021", F.when(c["swe_accepted"], "swe").otherwise("rejected"))
    for kind, profiles in TWO_LINE.items():
        told = told.when((c[f"{kind}_checks"] == VALID_CHECKS[kind]) & (automatic | profile.isin(*profiles)), kind)
    told = told.when(~automatic, "rejected")
    mexican = F.coalesce(hint["layout_hint"] == "mex_ine", F.lit(False))
    told = told.when(mexican & c["ine_accepted"], "ine").when(c["swe_accepted"], "swe").when(c["ine_accepted"], "ine")
    return told.when(c["ine_qr"], "ine_qr").when(c["catalog_evidence"], "catalog").otherwise("unsupported")


def pending(seen: DataFrame, stage: str) -> DataFrame:
    """The documents that a stage of observation is still needed for, given the stages before it."""
    if stage not in STAGES:
        raise ValueError(f"no stage {stage}; stages are {STAGES}")
    told = seen.withColumn("_route", route(seen))
    open_route = F.col("_route").isin("unsupported", "rejected", "ine")
    profile, auto = F.col("profile"), F.col("profile") == "auto_research"
    hint = F.col("layout_hint") if "layout_hint" in seen.columns else F.lit(None).cast("string")
    mrz = F.col("mrz_hint") if "mrz_hint" in seen.columns else F.lit(None).cast("string")
    need = {
        "barcodes": profile.isin("auto_research", "mex_ine", "aamva_pdf417") | scan_pdf417(profile, hint, mrz),
        "td1": open_route & profile.isin("mex_ine", "icao_td1", "auto_research"),
        "two_line": open_route & (auto | profile.isin(*(p for x in TWO_LINE.values() for p in x))),
        "visual": open_route & profile.isin("auto_research", "mex_ine", "swe_id_2021"),
        "catalog": (F.col("_route") == "unsupported") & auto,
    }
    return told.where(need[stage]).drop("_route")


def observe_in_stages(documents: DataFrame, observers: dict) -> DataFrame:
    """documents with all observations, the stages that each was observed in (`stages`, in order) and their route.

    observers: stage -> function of the pending documents to (doc_id, columns of OBSERVED). A stage without an observer is skipped; each stage
    sees only what is still open. What is known after a stage is written, so that a stage's observer runs once for each document, whatever is
    asked of the result; the table of the stage before is deleted then.
    """
    seen, last = documents.withColumn("stages", F.array().cast("array<string>")), None
    for stage in STAGES:
        if stage in observers:
            asked = pending(seen, stage)
            found = observers[stage](asked.drop("stages"))
            new = [c for c in found.columns if c != "doc_id"]
            looked = asked.select("doc_id", F.lit(True).alias("_looked"))
            joined = seen.drop(*new).join(found, "doc_id", "left").join(looked, "doc_id", "left")
            joined = joined.withColumn("stages", F.when(F.col("_looked"), F.concat("stages", F.array(F.lit(stage)))).otherwise(F.col("stages"))).drop("_looked")
            seen = written(joined, f"stage-{stage}")
            if last is not None:
                forget(last)
            last = seen
    return seen.withColumn("route", route(seen))


def stage_counts(routed: DataFrame) -> DataFrame:
    """stage, documents: how many documents each stage of observation was asked about."""
    return routed.select(F.explode("stages").alias("stage")).groupBy("stage").agg(F.count("*").alias("documents"))
