"""Documents with nulls, empty and long texts, ties, repeated rows, and further columns with clashing names."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CLASHING = ["m", "h", "n", "rid", "row", "kind", "kept", "rank", "value", "__text", "label"]


def words(text, lower=False):
    text = text or ""
    return WORD.findall(re.sub("[A-Z]", lambda x: x[0].lower(), text) if lower else text)


def documents(seed=1, families=5):
    """(doc_id, text) rows; ids are unique but for the last rows."""
    rnd = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in ("al", "be", "ce", "do", "é", "Fu") for b in range(60)]
    passage = " ".join(rnd.choice(vocabulary) for _ in range(60))
    texts = [None, "", "   ", "a", "A", "a b", "word " * 40, "x" * 9000 + " y", "\t\n", "one  two\nthree\r\n\x0bfour"]
    for _ in range(families):
        base = [rnd.choice(vocabulary) for _ in range(rnd.choice([12, 70, 160]))]
        for _ in range(6):
            copy = list(base)
            for _ in range(rnd.randrange(0, max(2, len(base) // 15))):
                copy[rnd.randrange(len(copy))] = rnd.choice(vocabulary)
            texts.append(" ".join(copy))
        texts.append(" ".join(base))
    for _ in range(6):
        own = [rnd.choice(vocabulary) for _ in range(80)]
        at = rnd.randrange(80)
        texts.append(" ".join([*own[:at], passage, *own[at:]]))
    texts.append(" ".join(rnd.choice(vocabulary) for _ in range(6000)))
    rnd.shuffle(texts)
    return [(3 * i - 7, t) for i, t in enumerate(texts)]


def frame(spark, rows, extra=True):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    if extra:
        from pyspark.sql import functions as F

        for c in CLASHING:
            df = df.withColumn(c, F.lit(c))
    return df
