"""Rows with every edge case: nulls, empty, white space only, very long, ties, repeated rows, clashing extra columns."""

import random

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, key long, rep long, comp long, norm string, n long"


def frame(spark: SparkSession, rows) -> DataFrame:
    return spark.createDataFrame([(i, t, None, None, None, 7, 7, 7, 7, "x", 7) for i, t in rows], SCHEMA)


def edge_rows(seed=1, n=60):
    r = random.Random(seed)
    vocabulary = [*("w%d" % i for i in range(60)), "É", "ça", "日本", "A", "the"]
    text = lambda k: " ".join(r.choice(vocabulary) for _ in range(k))
    passage = text(40)
    rows = [(0, None), (1, ""), (2, " \t\n\x0b\x0c\r "), (3, "one"), (4, "One"), (5, "two words"), (6, " 　"), (7, text(30_000))]
    i = len(rows)
    while i < n:
        kind = r.random()
        if kind < 0.3 and i > 12:
            t = rows[r.randrange(3, i)][1]
            if t and r.random() < 0.5 and len(t) < 9000:
                w = t.split(" ")
                w[r.randrange(len(w))] = "changed"
                t = r.choice([" ", "\n", "  "]).join(w)
        elif kind < 0.6:
            t = f"{text(r.randrange(0, 40))} {passage} {text(r.randrange(0, 40))}"
        else:
            t = text(r.randrange(1, 200))
        rows.append((i, t))
        i += 1
    return rows
