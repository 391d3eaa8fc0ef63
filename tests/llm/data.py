"""Small tables with nulls, empty and very long texts, ties, repeated rows and clashing column names."""

import random
import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile("[^\x20\x09-\x0d]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LANGS = {"en": ["the", "ing", "th", "wh", "and"], "fr": ["eau", "qu", "le", "ère", "oi"], "de": ["sch", "ein", "ung", "der", "ß"]}


def folded(text):
    return (text or "").translate(FOLD)


def prose(rng, lang, n):
    parts = LANGS[lang]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(n))


def documents(seed=1, n=80):
    rng = random.Random(seed)
    rows = []
    passage = prose(rng, "en", 30)
    for i in range(n):
        lang = rng.choice(list(LANGS))
        text = prose(rng, lang, rng.randint(1, 120))
        if i % 5 == 0:
            text += " " + passage
        rows.append((i, text, lang, f"s{rng.randint(0, 3)}" if rng.random() < 0.6 else "hot", len(text)))
    for i in range(12):  # near copies of one text, and exact ones in other letters
        base = rows[3][1].split() + prose(random.Random(9), "de", 60).split()
        if i:
            base[rng.randrange(len(base))] = "changed"
        rows.append((n + i, " ".join(base), "de", "hot", 5))
        rows.append((n + 50 + i, rows[7][1].upper().replace("È", "è").replace("ß".upper(), "ß") if i % 2 else rows[7][1], "en", "hot", None))
    rows += [
        (900, None, None, None, None), (901, "", "en", "s1", 0), (902, " \t\n", "fr", None, 3), (903, None, "de", "s2", None), (904, "12 34 !?", "en", "s1", 8),
        (905, prose(rng, "en", 30_000), "en", "s1", 1), (906, "a", None, "s0", 1), (907, "x" * 50_000, "fr", "s0", 1), (908, "ｆｕｌｌ ▁ 🙂 é\u0301", "fr", "s3", 9),
        (None, "the and ing the", "en", "s1", 4), (None, None, None, None, None), (910, "the and ing the", "en", "s1", 4), (910, "the and ing the", "en", "s1", 4),
    ]
    return rows


def frame(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, DOCS).repartition(3)


def clashing(df):
    """Extra columns with the names that operators use themselves."""
    from pyspark.sql import functions as F

    for name in ("id", "row", "norm", "part", "run", "kept", "size", "copies", "t", "at", "token", "comp", "letter", "piece_ids"):
        df = df.withColumn(name, F.lit(f"own {name}"))
    return df
