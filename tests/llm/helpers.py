"""Small documents with the cases that operators must bear."""

import random

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, d int, spans string, score double, __h int, k string"


def prose(r, n):
    return " ".join("".join(r.choice("abcdeéou") for _ in range(r.randint(1, 5))) for _ in range(n))


def documents(spark, seed=1, more=()):
    """Plain texts, copies, near copies, shared passages, nulls, empty texts, repeated rows and ids, a long text."""
    r = random.Random(seed)
    base = [prose(r, r.choice([3, 18, 40, 120, 200])) for _ in range(24)]
    passage = prose(r, 130)
    texts = list(base) + [base[5], base[5], base[7] + " end", "x " + base[9]]
    texts += [prose(r, 30) + " " + passage + " " + prose(r, 20) for _ in range(4)] + [passage, passage + " " + passage]
    near = base[10].split()
    texts += [" ".join("zz" if i == j else w for i, w in enumerate(near)) for j in (0, len(near) - 1)]
    texts += ["", " \t\n ", None, None, "same word " * 60, "a" * 900, prose(r, 6000)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, base[3]), (None, base[8]), (None, prose(r, 50)), (4, prose(r, 60)), *more]
    r.shuffle(rows)
    full = [(i, t, "en", "s", None if t is None else len(t), "x", 1, "y", 0.5, 2, "z") for i, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3), rows


def none_of(df):
    return df.where(F.lit(False))


def key_of(i):
    return (1 << 63) - 1 if i is None else i
