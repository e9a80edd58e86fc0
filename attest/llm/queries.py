"""The queries of this subpackage, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, fill_middle, langid, licenses, lm_scoring, mixing, near_dedup, packing, pii, quality, quality_trees, substrings, vector_codes
from .common import table


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup.marked(rows).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle=2)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_id(table(spark, sf_dir, "documents"), langid.remainder(F.col("doc_id"), 4) == 2)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.substring_dedup(table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents")).drop("_copies")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.lm_score(table(spark, sf_dir, "documents"), langid.remainder(F.col("doc_id"), 7) == 2)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.with_policy(quality.ledger(table(spark, sf_dir, "documents")))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_bits")


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_middle.fill_middle(table(spark, sf_dir, "documents"))
    again = fill_middle.restored(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(again, 256).alias("restored_sha256"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    rows = vector_codes.label_errors(coded.withColumn("code", F.lower(F.hex("code"))))
    return rows.select("vec_id", "code", "error", "label_error", F.lit(books.sha256() if books else "").alias("codebooks_sha256"))


def op13_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_trees.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), langid.remainder(F.col("doc_id"), 3) == 1)


QUERIES = {f.__name__: f for f in (op1_exact_dedup, op2_minhash_near_dedup, op3_language_id, op4_packing, op5_substring_dedup, op6_mixing, op7_license_scan, op8_pii, op9_lm_scoring, op10_quality_rules, op11_fill_middle, op12_vector_codes, op13_quality_classifier)}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_NORMAL = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')"

_OP1 = f"""
WITH t AS (SELECT doc_id, {_NORMAL} AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM t
"""

_OP6 = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         (('0x' || substr(md5('0:' || doc_id::VARCHAR), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY encode(source) NULLS LAST) AS k FROM s),
w AS (SELECT *, (k - 1) % 3 + 1 AS weight FROM r),
c AS (SELECT *, sum(source_size) OVER () AS total, sum(weight) OVER () AS total_w,
             3 * coalesce(sum(source_size) OVER o, 0) AS held, coalesce(sum(weight) OVER o, 0) AS held_w,
             row_number() OVER (ORDER BY source_size / weight, k) AS place
      FROM w WINDOW o AS (ORDER BY source_size / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (total - held)::DOUBLE / (total_w - held_w)::DOUBLE AS level FROM c),
f AS (SELECT *, min(CASE WHEN 3 * source_size > level * weight THEN place END) OVER () AS first_free FROM l),
g AS (SELECT source, source_size,
             CASE WHEN first_free IS NULL OR place < first_free THEN (3 * source_size)::DOUBLE
                  ELSE (SELECT min(level) FROM f AS x WHERE x.place = f.first_free) * weight END AS target
      FROM f),
p AS (SELECT *, target - sure * source_size AS lack FROM (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS sure FROM g)),
z AS (SELECT source, size, count(*) AS n FROM d WHERE size > 0 GROUP BY source, size),
q AS (SELECT z.source, size, lack, sum(n * size * size) OVER w AS squares, source_size - sum(n * size) OVER w AS larger, lead(size) OVER (PARTITION BY z.source ORDER BY size) AS next
      FROM z JOIN p ON z.source IS NOT DISTINCT FROM p.source WHERE lack > 0 WINDOW w AS (PARTITION BY z.source ORDER BY size)),
t AS (SELECT source, arg_min(squares / (lack - larger), size) AS t FROM q WHERE lack > larger AND (next IS NULL OR squares / (lack - larger) < next) GROUP BY source),
o AS (SELECT d.*, source_size, target, sure, lack, CASE WHEN size > 0 THEN coalesce(least(1, size / t), 0) ELSE 0 END::DOUBLE AS inclusion
      FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source LEFT JOIN t ON d.source IS NOT DISTINCT FROM t.source),
r2 AS (SELECT *, CASE WHEN inclusion >= 1 THEN 0 WHEN inclusion > 0 THEN u / (1 - u) * ((1 - inclusion) / inclusion) END AS rank FROM o),
j AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY size = 0, rank, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM r2)
SELECT doc_id, size, source_size, target,
       (size * CASE WHEN size = 0 THEN 0 ELSE sure + CASE WHEN lack > 0 AND lack - before >= size / 2 THEN 1 ELSE 0 END END)::BIGINT AS taken, inclusion
FROM j
"""


def _op7() -> str:
    known = ", ".join(f"({k}, {_quoted(name)}, {_quoted(notice)})" for k, (name, notice) in enumerate(licenses.TEMPLATES))
    words = r"string_split(trim(regexp_replace(lower({0}), '[^\pL\pN]+', ' ', 'g')), ' ')"
    pairs = "[w[i] || ' ' || w[i + 1] for i in range(1, len(w))]"
    return f"""
WITH t AS (SELECT *, list_distinct(seq) AS b, len(seq) AS n FROM (SELECT k, license_id, {pairs} AS seq FROM (SELECT k, license_id, {words.format("notice")} AS w FROM (VALUES {known}) AS v(k, license_id, notice)))),
d AS (SELECT row_number() OVER () AS id, doc_id, {pairs} AS g FROM (SELECT doc_id, {words.format("text")} AS w FROM documents WHERE text IS NOT NULL)),
c AS (SELECT d.*, t.*, ceil(len(t.b) * 0.8 / 1.2 - 1e-9) AS need FROM d JOIN t ON list_has_any(d.g, t.b)),
e AS (SELECT * FROM c WHERE len(list_intersect(list_distinct(g), b)) >= need),
p AS (SELECT e.*, unnest(list_filter([CASE WHEN list_position(seq, g[i]) > 0 THEN greatest(i - list_position(seq, g[i]), 0) END for i in range(1, len(g) + 1)], lambda x: x IS NOT NULL)) AS s FROM e),
s AS (SELECT id, doc_id, k, license_id, n, s, any_value(b) AS b, list_distinct(any_value(g)[s + 1 : s + n]) AS a FROM p GROUP BY id, doc_id, k, license_id, n, s HAVING count(*) >= ceil(len(any_value(b)) / 20)),
m AS (SELECT id, doc_id, k, license_id, n, s, 2.0::DOUBLE * len(list_intersect(a, b)) / (len(a) + len(b)) AS dice FROM s WHERE len(a) BETWEEN len(b) * 0.8 / 1.2 AND len(b) * 1.2 / 0.8),
h AS (SELECT * FROM m WHERE dice >= 0.8)
SELECT doc_id, license_id, max(dice)::DOUBLE AS dice, count(*) AS n_matches FROM h AS x
WHERE NOT EXISTS (SELECT 1 FROM h AS y WHERE y.id = x.id AND x.s < y.s + y.n AND y.s < x.s + x.n AND (y.dice, y.n, -y.k, -y.s) > (x.dice, x.n, -x.k, -x.s))
GROUP BY doc_id, license_id
"""


_OP11 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS w, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS digest FROM documents),
h AS (SELECT *, len(w)::BIGINT AS n, [('0x' || substr(digest, 8 * k + 1, 8))::BIGINT for k in range(0, 4)] AS h FROM d),
c AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS one, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS two,
             CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT doc_id, text, n, form, array_to_string(w[1:one], '') AS p, array_to_string(w[one + 1:two], '') AS m, array_to_string(w[two + 1:n], '') AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form != 'plain' THEN length(p)::BIGINT END AS prefix_chars, CASE WHEN form != 'plain' THEN length(m)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE text END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""


def _op12(rounds: int = 2) -> str:
    """Each round as tables: parts held against all entries of their place, and means of what each entry won."""
    near = """a{k} AS MATERIALIZED (SELECT r, part, arg_min(entry, away * 64 + entry) AS entry, min(away) AS away FROM (
  SELECT p.r, p.part, b.entry, list_sum([(p.x[i] - b.x[i]) * (p.x[i] - b.x[i]) for i in range(1, len(p.x) + 1)])::BIGINT AS away FROM p JOIN b{k} AS b USING (part)) GROUP BY r, part)"""
    mean = """b{k} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.x, b.x) AS x FROM b{j} AS b LEFT JOIN (
  SELECT part, entry, list(x ORDER BY i) AS x FROM (
    SELECT part, entry, i, (sum(x) // count(*) - CASE WHEN sum(x) < 0 AND sum(x) % count(*) != 0 THEN 1 ELSE 0 END)::BIGINT AS x FROM (SELECT p.part, a.entry, unnest(p.x) AS x, unnest(range(0, len(p.x))) AS i FROM p JOIN a{j} AS a USING (r, part)) GROUP BY part, entry, i)
  GROUP BY part, entry) AS m USING (part, entry))"""
    steps = ",\n".join(near.format(k=k) + (",\n" + mean.format(k=k + 1, j=k) if k < rounds else "") for k in range(rounds + 1))
    return f"""
WITH v AS (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, [floor(256 * x::DOUBLE)::BIGINT for x in embedding] AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT r, part, x[part * (len(x) // 16) + 1 : (part + 1) * (len(x) // 16)] AS x FROM v, (SELECT unnest(range(0, 16)) AS part)),
b0 AS MATERIALIZED (SELECT part, r - 1 AS entry, x FROM p WHERE r <= 64),
{steps},
s AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{rounds}),
f AS (SELECT r, string_agg(printf('%02x', entry::INT), '' ORDER BY part) AS code, sum(away)::BIGINT AS error FROM a{rounds} GROUP BY r)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM v JOIN f USING (r), s
"""


ORACLES = {"op1_exact_dedup": _OP1, "op6_mixing": _OP6, "op7_license_scan": _op7(), "op11_fill_middle": _OP11, "op12_vector_codes": _op12()}
