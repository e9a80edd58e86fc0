"""Small tables that every operator must bear."""

import random

DDL = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and to in that is was for it with as his on be at by had not are but from or have an they which one you were all her she there would their we him been has when who will no more if out".split()


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", "", "ly", "ing"]) for _ in range(n))


def documents(spark):
    """Nulls in every column, empty and long texts, copies, near copies, shared passages, ties and repeated rows."""
    shared = prose(40, 1)
    base = prose(120, 2)
    near = base.split()
    near[50] = "changed"
    rows = [
        (1, base, "en", "a"),
        (2, base.replace(" ", "  "), "en", "a"),
        (3, " ".join(near), "en", "b"),
        (4, None, None, None),
        (5, "", "en", "b"),
        (6, " \t\n ", "fr", "b"),
        (7, "word", "en", "c"),
        (8, shared + " " + prose(30, 3), "en", "c"),
        (9, prose(25, 4) + " " + shared + " " + prose(9, 5), None, "c"),
        (10, prose(9000, 6), "de", "d"),
        (10, prose(9000, 6), "de", "d"),
        (11, "x" * 40_000, "es", "d"),
        (None, base, "en", None),
        (None, "no id here, yet words", None, "a"),
        (12, "Łódź żółć naïve  ünï – «çödé» 𝒳𝒴", "fr", "é"),
        (13, base.upper(), "en", "a"),
        (14, "tail ends in space \n\n and  gaps ", "en", "a"),
        (15, "<|endoftext|> it's 'tis don't 12 345", "en", "b"),
        (16, "one <|endoftext|><|endoftext|> two  <|endoftext|>", "en", "b"),
    ]
    return spark.createDataFrame([(i, t, x, s, None if t is None else len(t)) for i, t, x, s in rows], DDL)


def empty(spark):
    return spark.createDataFrame([], DDL)


def clashing(df):
    """The table with columns named like what the operators add."""
    from pyspark.sql import functions as F

    names = "keep_id kept size target taken word c key id component text_sha256 score held_out row starts length _digest _u _bin _row"
    return df.select("*", *(F.lit("clash").alias(x) for x in names.split()))


def texts(df):
    return [(r["doc_id"], r["text"] or "") for r in df.collect()]
