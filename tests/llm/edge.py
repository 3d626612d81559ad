"""Small inputs with nulls, empty and long texts, ties, repeated rows and clashing column names."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = ("doc_id bigint, text string, lang string, source string, n_chars bigint, score double, size bigint, row string, "
          "n bigint, label int, piece int, length bigint, rank bigint, `a.b` string")


def frame(spark, rows):
    """(doc_id, text, source) rows with extra columns whose names operators use themselves."""
    return spark.createDataFrame([(i, t, None, s, None if t is None else len(t), 0.5, 7, "x", 1, 1, 2, 3, 4, None) for i, t, s in rows], SCHEMA)


def edge_rows(seed=1):
    rng = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(300)] + ["äé", "X*", "!!"]
    base = [rng.choice(vocabulary) for _ in range(120)]
    long = " ".join(rng.choice(vocabulary) + str(rng.randrange(50)) for _ in range(20_000))
    rows = [(1, None, "s1"), (2, "", "s2"), (3, " \t\n\x0b ", None), (4, "one", "s1"), (5, "one two", "s1"), (6, "one two three", "s2"),
            (7, "\n".join(" ".join(base[i:i + 12]) for i in range(0, 120, 12)), "s1"), (8, "\n".join(" ".join(base[i:i + 12]) for i in range(0, 120, 12)), None),
            (9, " ".join(base), "s2"), (10, " ".join(base[:-1] + ["other"]), "s2"), (11, "  " + " ".join(base) + "\n\n", "s1"),
            (12, long, "s3"), (13, long + " tail", "s3"), (14, "One TWO", None), (15, "a\tb\r\nc\x0cd a\tb", "s1"), (None, "null id text here", "s2"), (None, None, None)]
    rows += [(20 + i, " ".join(base[:20 + i]), "s4") for i in range(12)]
    rows += [(40 + i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 60))), rng.choice(["s1", "s2", None])) for i in range(25)]
    return rows + [rows[3], rows[6], rows[15], rows[16]]
