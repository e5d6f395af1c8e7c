"""Small tables with every awkward case: nulls, empty and long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

import random

WORDS = [w.strip() for w in "the of and to in is that with for on as by at from this it are was be or".split()]
CLASH = "key string, range int, c0 int, score double, kept string, ranges string, id int, h int, a int, at int, text_ string, component_id int"


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) if rng.random() < 0.4 else "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(n))


def documents(seed: int = 0) -> list[tuple]:
    rng = random.Random(seed)
    out = [(i, prose(rng, rng.randint(1, 120)), rng.choice(["en", "fr"]), "s", 1) for i in range(40)]
    base = out[3][1] + " " + prose(rng, 100)
    for i in range(40, 60):  # near copies
        words = base.split()
        for _ in range(i % 7):
            words[rng.randrange(len(words))] = "zz"
        out.append((i, " ".join(words), "en", "s", 1))
    out += [(i, base, "en", "s", 1) for i in range(60, 70)]  # exact copies
    passage = prose(rng, 60)
    out += [(i, prose(rng, 20) + "\n" + passage + "\nshared line two\n" + prose(rng, 20), "fr", "s", 1) for i in range(70, 80)]
    out += [(80, None, None, None, None), (81, "", "en", "s", 0), (82, "   \n\t", "en", None, 6), (83, "!!! 123 ???", None, "s", 1), (84, "one", "en", "s", 1), (85, prose(rng, 9000), "en", "s", 1), (86, "x" * 30_000, "en", "s", 1)]
    out += [(None, "no id at all " + passage, "en", "s", 1), (5, out[5][1], "en", "s", 1), (6, "the same id with another text " + passage, "en", "s", 1)]
    out += [(87, "漢字かな交じり文 and latin", "ja", "s", 1), (88, "naïve café 😀 \x00 \x1c end", "fr", "s", 1)]
    return out


def frame(spark, rows=None, extra: bool = False):
    rows = documents() if rows is None else rows
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3)
    if extra:
        from pyspark.sql import functions as F

        for part in CLASH.split(", "):
            name, kind = part.split()
            df = df.withColumn(name, F.lit(1).cast(kind))
    return df


def empty(spark):
    return frame(spark, [])
