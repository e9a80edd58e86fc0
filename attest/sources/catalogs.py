"""Catalogs and evaluation files: JSON documents, gzip JSON layouts, CSV records. Schemas are declared, never inferred."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from ..operators.evaluation import label

_NAMED = "struct<name:string,value:int>"
DOCUMENT = f"identifier bigint, caption string, country string, isoCodes array<string>, documentType {_NAMED}, documentFormat {_NAMED}, mrz struct<present:boolean,ignored:boolean,expectedProfile:string>, barcode struct<present:boolean>, deprecated boolean, year string, series string, stateCodes array<string>, issuedFrom string, issuedTo string"
CATALOG = f"identifierMap array<struct<outputIndex:int,documentIdentifier:bigint,document:struct<{', '.join(x.replace(' ', ':', 1) for x in DOCUMENT.split(', '))}>>>"
_FIELD = "struct<number:int,type:int,name:string,bounds:array<double>,mask:string,lcid:int,textHeight:double,colorType:int,fontLayer:int,layer:int,lightType:int,inComparison:int,lowContrastText:boolean,removeBackground:boolean>"
_GRAPHIC = "struct<number:int,type:int,name:string,bounds:array<double>,lightType:int,layer:int,checkFacePresent:boolean>"
_BARCODE = "struct<number:int,type:int,name:string,bounds:array<double>,orientation:int,codeType:int,codeClass:int,pdf417Codec:int,lightType:int,layer:int>"
_SECURITY = "struct<number:int,name:string,bounds:array<double>,lightType:int,checkType:int>"
_PATCH = "struct<number:int,bounds:array<double>,lightType:int,master:boolean,stored:boolean,image:struct<format:string,dpi:int,data:string,sha256:string>>"
_PART = "struct<kind:string,type:int,locale:int,value:string>"
LAYOUT = f"struct<identifier:bigint,caption:string,country:string,isoCodes:array<string>,documentType:{_NAMED},documentFormat:{_NAMED},year:string,orientation:int,dimensionsMm:struct<width:double,height:double>,twoSided:boolean,mainDocument:boolean,parentIdentifier:bigint,childDocuments:array<bigint>,pairedPages:array<bigint>,fields:array<{_FIELD}>,graphics:array<{_GRAPHIC}>,barcodes:array<{_BARCODE}>,securityRegions:array<{_SECURITY}>,referencePatches:array<{_PATCH}>,assemblies:array<struct<target:struct<type:int,name:string,locale:int>,parts:array<{_PART}>>>,catalogHints:map<string,string>>"


def _there(spark: SparkSession, path: str) -> bool:
    """Whether a path exists, asked of the file system that Spark reads it with."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _snake(df: DataFrame) -> DataFrame:
    snake = lambda c: "".join("_" + x.lower() if x.isupper() else x for x in c)
    return df.toDF(*(snake(c) for c in df.columns))


def document_catalog(spark: SparkSession, path: str, sha256: str | None = None) -> DataFrame:
    """Documents with the class index that names them; entries without a document go. No file is an empty catalog; a file with another digest than the one given fails the query."""
    if not _there(spark, path):
        rows = spark.createDataFrame([], CATALOG)
    else:
        raw = spark.read.text(path, wholetext=True)
        if sha256:
            raw = raw.withColumn("value", F.when(F.sha2("value", 256) == sha256, F.col("value")).otherwise(F.raise_error(F.lit("the catalog's digest differs"))))
        rows = raw.select(F.from_json("value", CATALOG).alias("c")).select("c.*")
    e = rows.select(F.explode("identifierMap").alias("e")).where(F.col("e.document").isNotNull())
    out = _snake(e.select(F.col("e.outputIndex").alias("outputIndex"), "e.document.*"))
    return out.withColumns({"document_type_code": F.col("document_type.value"), "document_type": F.col("document_type.name"), "document_format": F.col("document_format.name")})


def layout_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Layouts of a JSON object (plain or gzip) keyed by identifier, with country_codes: three-letter codes in upper case. No file is an empty catalog."""
    if not _there(spark, path):
        rows = spark.createDataFrame([], f"l {LAYOUT}")
    else:
        rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"map<string,{LAYOUT}>")).alias("k", "l")).select("l")
    out = _snake(rows.select("l.*"))
    return out.withColumn("country_codes", F.transform(F.filter(F.coalesce("iso_codes", F.array().cast("array<string>")), lambda c: c.rlike("^[A-Za-z]{3}$")), F.upper))


MODES = (("score", ("score",)), ("template", ("template1Base64", "template2Base64")), ("image", ("image1", "image2")))


def input_mode(columns: list[str]) -> str:
    """score before template before image."""
    for mode, needed in MODES:
        if "samePerson" in columns and set(needed) <= set(columns):
            return mode
    raise ValueError("the file needs samePerson, and score, two templates or two images")


def evaluation_records(spark: SparkSession, path: str, scored=None) -> DataFrame:
    """pair_id, same_person, score, error of a CSV file with a header (and perhaps a byte-order mark).

    In template and image mode, `scored` takes the rows (pair_id, a, b) to (pair_id, score). error names what is wrong with a row:
    label, score; good rows have none.
    """
    rows = spark.read.csv(path, header=True, encoding="UTF-8", mode="PERMISSIVE")
    rows = rows.toDF(*(c.lstrip("\ufeff").strip() for c in rows.columns))
    mode = input_mode(rows.columns)
    pair = F.col("pairIdentifier") if "pairIdentifier" in rows.columns else F.lit(None).cast("string")
    base = rows.withColumn("pair_id", pair).withColumn("same_person", label(F.col("samePerson")))
    if mode == "score":
        out = base.withColumn("score", F.col("score").try_cast("double"))
    else:
        if scored is None:
            raise ValueError(f"{mode} mode needs a scorer")
        a, b = dict(MODES)[mode]
        out = base.join(scored(base.select("pair_id", F.col(a).alias("a"), F.col(b).alias("b"))), "pair_id", "left")
    error = F.when(F.col("same_person").isNull(), "label").when(F.col("score").isNull() | F.isnan("score") | ~F.col("score").between(0, 1), "score")
    return out.select("pair_id", "same_person", "score", error.alias("error"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 1), value: the lines of text files with their numbers in each file, whatever the splits that files are read in.

    A split's lines are counted first: a sum over the splits before it tells where its own begin. A file is numbered by nobody alone.
    """
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"))
    blocks = rows.groupBy("file", "_block").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    before = Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    return rows.join(blocks, ["file", "_block"]).select("file", (F.col("_before") + F.col("_id") - F.col("_first") + 1).alias("line"), "value")


def checked_records(spark: SparkSession, path: str) -> DataFrame:
    """file, line, pair_id, same_person, score, problem, value: the rows of CSV files of scores, each with its line in its file (the header is line 1) and what is wrong with it, or null.

    Each file begins with its own header, in any order of names; a record is a line. problem: fields (more or fewer than the header has), label, score (no number of
    0 to 1). A file whose header lacks samePerson or score fails the query. Blank lines are left out. Nothing is dropped: bad rows keep their text, in value.
    """
    lines = numbered_lines(spark, path)
    heads = lines.where(F.col("line") == 1).select("file", F.transform(F.split(F.regexp_replace("value", "^\ufeff", ""), ","), lambda x: F.trim(F.regexp_replace(x, '^"|"$', ""))).alias("_names"))
    whole = F.array_contains("_names", "samePerson") & F.array_contains("_names", "score")
    heads = heads.withColumn("_names", F.when(whole, F.col("_names")).otherwise(F.raise_error(F.concat(F.lit("no samePerson and score in "), F.col("file")))))
    rows = lines.where((F.col("line") > 1) & (F.trim("value") != "")).join(heads, "file")
    # A field is text without commas, or text in quotes in which quotes are doubled.
    fields = F.transform(F.regexp_extract_all(F.concat(F.lit(","), F.col("value")), F.lit(',("(?:[^"]|"")*"|[^,]*)'), F.lit(1)), lambda x: F.when(x.startswith('"'), F.replace(F.regexp_replace(x, '^"|"$', ""), F.lit('""'), F.lit('"'))).otherwise(x))
    rows = rows.withColumn("_fields", fields)
    rows = rows.withColumn("_map", F.when(F.size("_fields") == F.size("_names"), F.map_from_arrays("_names", "_fields")))
    get = lambda name: F.try_element_at("_map", F.lit(name))
    score = get("score").try_cast("double")
    same = label(get("samePerson"))
    problem = F.when(F.col("_map").isNull(), "fields").when(same.isNull(), "label").when(score.isNull() | F.isnan(score) | ~score.between(0, 1), "score")
    return rows.select("file", "line", F.nullif(get("pairIdentifier"), F.lit("")).alias("pair_id"), same.alias("same_person"), score.alias("score"), problem.alias("problem"), "value")


def quarantined(rows: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """Rows without a problem, and the others, told apart in one pass that writes both below a folder."""
    rows.withColumn("bad", F.col("problem").isNotNull()).write.partitionBy("bad").parquet(folder)
    both = rows.sparkSession.read.schema(StructType([*rows.schema.fields, StructField("bad", BooleanType())])).parquet(folder)
    return both.where(~F.col("bad")).drop("bad", "problem", "value"), both.where("bad").select("file", "line", "problem", "value")


def distinct_once(paths: DataFrame, columns: list[str], embed) -> DataFrame:
    """paths (pair_id, two path columns) with an embedding for each: every distinct path is embedded once, then joined back."""
    one = paths.select(F.explode(F.array(*columns)).alias("path")).where(F.col("path").isNotNull()).distinct()
    found = embed(one)
    out = paths
    for c in columns:
        out = out.join(found.select(F.col("path").alias(c), F.col("embedding").alias(f"{c}_embedding")), c, "left")
    return out


def write_report(report: DataFrame, path: str, pretty: bool = False) -> None:
    """One JSON document a row."""
    report.select(F.to_json(F.struct("*"), {"pretty": str(pretty).lower(), "ignoreNullFields": "false"}).alias("value")).write.mode("error").text(path)


def environment_root(default: str = "assets", name: str = "ATTEST_ASSETS") -> str:
    return os.environ.get(name, default)
