"""Small tables with the awkward cases that every operator must bear."""

import random

from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def sentence(seed: int, n: int) -> str:
    g = random.Random(seed)
    return " ".join(g.choice(WORDS) + str(g.randrange(50)) for _ in range(n))


def documents(spark, rows, extra=False):
    """Rows (doc_id, text, lang, source) as documents; `extra` adds columns whose names operators use inside."""
    df = spark.createDataFrame([(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows], DOCS)
    if extra:
        df = df.withColumns({c: F.lit(1) for c in ("key", "t", "h", "size", "copies", "node", "blob", "data", "kept", "label", "rank", "id")})
    return df


def awkward():
    """Nulls, empty, blank, one word, repeated rows, ties, a long text."""
    long_text = sentence(1, 30_000)
    return [
        (1, None, "en", "a"), (2, "", "en", None), (3, " \t\n", None, "b"), (4, "word", "de", "a"), (5, "word", "de", "b"), (6, "WORD", None, "b"), (7, sentence(2, 60), "en", "a"), (7, sentence(2, 60), "en", "a"),
        (8, long_text, "en", "c"), (9, long_text[:-20] + " tail", "en", "c"), (10, "日本語 テキスト é", "fr", None), (11, "12345 !!! ###", "en", "a"),
    ]
