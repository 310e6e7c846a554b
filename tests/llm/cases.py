"""Documents with the cases that every operator has to bear, and a plain reading of words."""

import random
import re

from pyspark.sql import functions as F

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Names that the operators use for themselves, here columns of the caller's.
CLASHES = ["start", "size", "n_tokens", "part_", "pos_", "_at", "root", "key", "text_id", "before", "bits", "n_bytes", "lowered_", "block", "shard", "set_id", "tree", "tie", "_copy", "_text", "_id", "limit", "weight"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def syllables(rng, n, parts=("an", "the", "ou", "er", "ing", "tion", "ble", "sh", "on", "ed")):
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(n))


def edge_rows(seed=5):
    rng = random.Random(seed)
    base = syllables(rng, 120)
    near = base.split()
    near[60] = "changed"
    rows = [
        (0, base, "en", "b"),
        (1, base, "en", "b"),
        (2, " ".join(near), "en", "a"),
        (2, " ".join(near), "en", "a"),  # a row that repeats
        (3, None, "en", "a"),
        (4, "", None, None),
        (5, " \t\n ", "en", "a"),
        (6, "One", "en", "a"),
        (7, "One two", "en", "b"),
        (8, "one TWO", "de", None),
        (9, syllables(rng, 40_000), "en", "long"),
        (None, syllables(rng, 50), "en", "a"),
        (None, base, None, "b"),
        (10, "Straße  naïve x 中文 don't we're\r\n\r\nend. ", "de", "é"),
        (11, "same id, one text", "en", "a"),
        (11, "same id, another text", "en", "a"),
        (-5, "Licensed under CC BY-NC 4.0.\nAll rights reserved. cc by", "en", "a"),
        (12, "<|endoftext|> and \0 a zero", "en", "a"),
    ]
    return [(*r, len(r[1] or "")) for r in rows]


def documents(spark, rows=None, clashes=True):
    df = spark.createDataFrame(edge_rows() if rows is None else rows, SCHEMA)
    return df.select("*", *[F.lit("x").alias(c) for c in CLASHES]) if clashes else df


def prose(seed, n, low=20, high=200):
    """Documents of invented prose, some of them copies or near copies."""
    rng = random.Random(seed)
    rows, texts = [], []
    for i in range(n):
        kind = rng.random()
        if texts and kind < 0.15:
            text = rng.choice(texts)
        elif texts and kind < 0.45:
            w = rng.choice(texts).split()
            for _ in range(rng.randint(1, max(1, len(w) // 25))):
                w[rng.randrange(len(w))] = syllables(rng, 1)
            text = " ".join(w)
        else:
            text = syllables(rng, rng.randint(low, high))
        texts.append(text)
        rows.append((i, text, rng.choice(["en", "de"]), rng.choice(["a", "b", "c", "d"]), len(text)))
    return rows
