from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns that bear the names that operators use inside or return.
CLASHING = ["language", "lead", "group", "jaccard", "gone", "hit", "slot", "block", "epoch", "key", "shard", "tokens", "score", "toxic", "hash", "n", "need", "row", "words"]


def frame(spark, rows, clashing=False):
    """documents of (doc_id, text, lang, source)."""
    df = spark.createDataFrame([(i, t, g, s, len(t or "")) for i, t, g, s in rows], DOCS)
    if clashing:
        for c in CLASHING:
            from pyspark.sql import functions as F

            df = df.withColumn(c, F.lit("x"))
    return df


def words(seed, n, vocabulary=2000):
    rng = random.Random(seed)
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def edited(text_words, edits, seed):
    rng = random.Random(seed)
    out = list(text_words)
    for _ in range(edits):
        at = rng.randrange(len(out))
        kind = rng.randrange(3)
        if kind == 0:
            out[at] = f"e{rng.randrange(10**6)}"
        elif kind == 1:
            out.insert(at, f"e{rng.randrange(10**6)}")
        elif len(out) > 1:
            del out[at]
    return out


def awkward(spark, clashing=True):
    """Nulls in every column, empty and long texts, repeated rows and ties."""
    long_text = " ".join(words(1, 30_000))
    rows = [
        (1, None, "en", "a"), (2, "", "en", "a"), (3, "one", None, None), (None, "no id here at all", "en", "b"), (4, long_text, "de", "b"), (5, "same text for all of us here", "en", "b"),
        (5, "same text for all of us here", "en", "b"), (6, "same text for all of us here", "fr", None), (7, "!!! ??? ...", None, "c"), (None, None, None, None), (8, "é ü ñ 漢字 🙂", "fr", "c"),
    ]
    return frame(spark, rows, clashing)
