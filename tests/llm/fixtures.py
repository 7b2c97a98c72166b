"""Small tables with the awkward cases: nulls, empty and long texts, ties,
repeated rows, columns whose names clash with the operators' own."""

import random

from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()),
    # clashing names
    T.StructField("id", T.StringType()), T.StructField("row", T.StringType()),
    T.StructField("n_words", T.StringType()), T.StructField("kept", T.StringType()),
    T.StructField("epoch", T.StringType()), T.StructField("p", T.StringType()),
    T.StructField("spans", T.StringType()), T.StructField("body", T.StringType())])


def frame(spark, rows):
    """Documents from (doc_id, text) or (doc_id, text, lang, source)."""
    full = [(*r, *([None] * (4 - len(r))))[:4] for r in rows]
    return spark.createDataFrame(
        [(*r, len(r[1]) if r[1] is not None else None, "x", "x", "x", "x", "x", "x", "x", "x") for r in full], SCHEMA)


def words(n, seed, vocabulary=400):
    rng = random.Random(seed)
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def edited(base, changes, seed):
    rng = random.Random(seed)
    out = list(base)
    for _ in range(changes):
        out[rng.randrange(len(out))] = f"x{rng.randrange(10 ** 6)}"
    return out


def awkward(seed=0):
    """(doc_id, text) rows."""
    base = words(60, seed)
    passage = " ".join(words(45, seed + 1))
    rows = [
        (1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (4, "one"), (5, "one two"), (6, "One TWO"),
        (7, " ".join(base)), (8, " ".join(base)), (None, " ".join(base)), (None, None),
        (9, "\t" + "\n".join(base) + "  "), (9, "\t" + "\n".join(base) + "  "),
        (10, " ".join(edited(base, 2, 1))), (11, " ".join(edited(base, 9, 2))),
        (12, "In. " * 300), (13, "In. " * 301), (14, "a" * 450), (15, "é" * 300), (16, "aé ß" * 200),
        (17, passage + " tail one"), (18, "head two " + passage), (19, f"mid {passage} three"),
        (20, " ".join(words(20000, 5, 10 ** 6)) + " " + passage), (21, " ".join(words(12, 7))),
        (22, " ".join(words(12, 7))), (23, " ".join(words(13, 7))), (24, "𝔘nicode  words here " * 9),
    ]
    rows += [(100 + k, f"left {k} {' '.join(words(9, 50 + k))} {passage} {' '.join(words(7, 90 + k))}") for k in range(80)]
    return rows
