import hashlib
import math
import re
from collections import Counter

import duckdb
import pandas as pd
import pytest

from attest.llm import queries

from .cases import clashing, prose
from .test_operators import check_packing, components_by_force, ranks_by_force, targets_by_force

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_sql_agrees(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want, got = con.sql(queries.ORACLES[name]).df(), queries.QUERIES[name](spark, sf_dir).toPandas()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    pd.testing.assert_frame_equal(*(x[cols].sort_values(cols).reset_index(drop=True) for x in (got, want)), check_dtype=False)


def junk_by_force(text):
    """The rules of the latest policy, written down anew."""
    words = [w for w in re.split("[\x20\x09-\x0D]+", text) if w]
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0D]", x)]
    letters, capitals, chars = sum(c.isalpha() for c in text), sum(c.isupper() for c in text), sum(map(len, words))
    windows = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
    often = {j for k in range(len(words) - 4) if windows[tuple(words[k : k + 5])] > 1 for j in range(k, k + 5)}
    again = len(lines) - len(set(lines))
    return (
        len(words) < 10 or len(often) > 0.2 * len(words) or sum(c in "#*$%&|<>" for c in text) > 0.07 * chars or (again >= 3 and again > 0.5 * len(lines))
        or (letters >= 50 and capitals > 0.7 * letters) or (chars and letters < 0.3 * chars) or sum(a == b for a, b in zip(words, words[1:])) > 0.3 * len(words)
    )


def mixed_by_force(rows):
    """(doc_id, text, source) -> how often each row is taken."""
    size = lambda t: len(re.findall("[^\x20\x09-\x0D]+", t or ""))
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += size(t)
    target = targets_by_force(sizes)
    out = Counter()
    for s in sizes:
        own = [(i, t) for i, t, x in rows if x == s and size(t)]
        if not own:
            continue
        sure = math.floor(target[s] / sizes[s])
        lack = target[s] - sure * sizes[s]
        told = ranks_by_force([(i, t, size(t)) for i, t in own], lack)
        words = 0
        for (_, n), i, t in sorted(((key, i, t) for (i, t), (key, _) in zip(own, told, strict=True)), key=lambda r: r[0]):
            out[i, t] += sure + (lack > 0 and lack - words >= n / 2)
            words += n
    return out


def fixture():
    """Clean texts, copies, near copies in chains, junk, nulls, ties, repeated rows."""
    rows = []
    for k in range(40):
        text = " ".join(f"{w}{j * 7 % (11 + k)}" if j % 3 else w for j, w in enumerate(prose(60 + 5 * k, 300 + k).split()))
        rows.append((k, text, "en", "abc"[k % 3]))
        words = text.split()
        if k % 4 == 0:
            rows.append((1000 + k, text.replace(" ", "  \t"), "en", None))
        if k % 5 == 0:
            for step in range(3):
                words = [*words]
                words[10 + 17 * step] = f"other{step}"
                rows.append((2000 + 10 * k + step, " ".join(words), None, "d"))
    rows += [(5000, None, None, None), (5001, "", "en", "a"), (5002, "too few words", "en", "a"), (5003, "AGAIN AND AGAIN " * 40, "en", "b"), (5004, "$$ ## " * 100, "en", "b"), (None, prose(70, 999), "en", "a"), (7, rows[8][1], "en", "z"), (3, rows[3][1], "en", "a"), (3, rows[3][1], "en", "a")]
    return rows


DDL = "doc_id long, text string, lang string, source string"


@pytest.mark.parametrize("extra", [False, True])
def test_pipeline_is_brute_force(spark, tmp_path, extra):
    import corpus_pipeline
    import public_tokenizers as P
    from tokenizers import Tokenizer

    rows = fixture()
    df = spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in rows], DDL + ", n_chars long")
    if extra:
        df = clashing(df)
    df.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    told = lambda df: Counter((r.doc_id, r.text) for r in df.collect())
    want = [(i, t, s) for i, t, _, s in rows]
    stage = dict(corpus_pipeline.STAGES)

    want = [r for r in want if not junk_by_force(r[1] or "")]
    docs = stage["quality_rules"](spark, docs, str(tmp_path))
    assert told(docs) == Counter(r[:2] for r in want) and docs.columns == df.columns

    normal = lambda t: re.sub("[\x20\x09-\x0D]+", " ", t or "")
    least = {}
    for i, t, _ in want:
        least.setdefault(normal(t), []).append(i)
    least = {t: min((i for i in ids if i is not None), default=None) for t, ids in least.items()}
    want = [r for r in want if least[normal(r[1])] == r[0]]
    docs = stage["exact_dedup"](spark, docs, str(tmp_path))
    assert told(docs) == Counter(r[:2] for r in want) and docs.columns == df.columns

    found = components_by_force([(i, t or "") for i, t, _ in want], 5)
    want = [r for r, (i, _, c) in zip(want, found, strict=True) if i == c]
    docs = stage["near_dedup"](spark, docs, str(tmp_path))
    assert told(docs) == Counter(r[:2] for r in want) and docs.columns == df.columns

    taken = mixed_by_force(want)
    docs = stage["mixing"](spark, docs, str(tmp_path))
    assert told(docs) == +taken and docs.columns == df.columns
    assert {tuple(r) for r in docs.collect()} <= {tuple(r) for r in df.collect()}

    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    flat = [(i, t) for (i, t), n in taken.items() for _ in range(n)]
    check_packing(stage["packing"](spark, docs, str(tmp_path)).collect(), flat, tokenizer, 0.2)  # seven sequences, of which the last is not full
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    check_packing(whole, flat, tokenizer, 0.2)


def test_pipeline_of_nothing(spark, tmp_path):
    import corpus_pipeline

    for k, rows in enumerate(([], [(None, None, None, None), (1, None, None, None), (2, "", None, None)])):
        spark.createDataFrame(rows, DDL).write.parquet(f"{tmp_path}/{k}/documents.parquet")
        assert corpus_pipeline.run(spark, f"{tmp_path}/{k}").count() == 0


def test_what_a_pipeline_writes_for_itself_is_deleted(spark, sf_dir):
    import corpus_pipeline

    from attest.llm import common

    before = list(common._made.get(spark.sparkContext.applicationId, []))
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.count() > 0 and common._made.get(spark.sparkContext.applicationId, []) == before
    with common.Scratch(spark):
        t = common.written(spark.range(3), "test")
        common.forget(common.written(t, "test"))
        assert t.count() == 3
    assert common._made.get(spark.sparkContext.applicationId, []) == before
