"""Small corpora with every awkward row, and brute-force models."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n string, size string, key string, h string, row string, rank string"


def frame(spark, rows):
    """(doc_id, text, source) rows with further columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), *"nskhra") for i, t, s in rows], SCHEMA)


def awkward(seed: int = 1, n: int = 60):
    """Copies, near copies, shared passages, long, empty, blank and null texts, null and repeated ids."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeé") for _ in range(r.randint(2, 7))) for _ in range(400)]
    prose = lambda k: " ".join(r.choice(vocabulary) for _ in range(k))
    passage = prose(120)
    base = [prose(r.randint(20, 200)) for _ in range(8)]
    rows = [(None, None, None), (1, None, "a"), (2, "", "a"), (3, " \n\t ", "b"), (4, "one two", "b"), (None, prose(30), None), (5, "x" * 3000, "c")]
    for i in range(10, 10 + n):
        kind = r.randrange(6)
        if kind == 0:
            text = r.choice(base)
        elif kind == 1:
            words = r.choice(base).split()
            words[r.randrange(len(words))] = "Edited"
            text = " ".join(words)
        elif kind == 2:
            text = prose(r.randint(1, 60)) + "\n" + passage + "\n" + prose(r.randint(1, 60))
        elif kind == 3:
            text = prose(r.randint(1, 8))
        elif kind == 4:
            text = r.choice(base).upper()
        else:
            text = prose(r.randint(50, 700))
        rows.append((i, text, r.choice(["a", "b", "hot", "hot", None])))
    return rows + [rows[-1], rows[-1], (10, prose(40), "a")]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def collected(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=lambda r: tuple((x is None, x) for x in r))


def empty(spark):
    return frame(spark, [(1, "a", "b")]).where(F.lit(False))
