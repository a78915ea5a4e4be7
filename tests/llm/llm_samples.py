"""Small documents with everything that may go wrong, and plain versions of what words and shingles are."""

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, score string, spans string, _id string, fp string, rep string, bucket string, first string, start string, word string, bands string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def words(text):
    return WORD.findall(text or "")


def sentence(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}{rng.choice(['', '', '.', 'é'])}" for _ in range(n))


def nasty_texts():
    """(doc_id, text): nulls, empty and blank texts, short and very long ones, exact and near copies, repeated rows and ids, shared passages."""
    rng = random.Random(5)
    base, other, passage = sentence(rng, 120), sentence(rng, 90), sentence(rng, 60)
    near = base.split(" ")
    near[50] = "changed"
    long = sentence(rng, 30_000, 9_000)
    rows = [
        (1, None), (2, ""), (3, " \n\t \r\n"), (4, "one"), (5, "One  two\nthree"), (6, "one two three"), (7, base), (8, base.upper()), (9, " ".join(near)), (10, other + "\n" + passage),
        (11, passage + "\v" + sentence(rng, 40)), (12, long), (13, long), (14, "same " * 300), (15, "same " * 80), (16, "日本語 テキスト 　 x y 😀 <|endoftext|> ###"), (17, other), (17, other), (18, None), (19, "a\n" * 70),
        (None, base), (None, None), (None, "no id at all"), (-5, other + " tail"), (20, "x" * 200_000), (21, sentence(rng, 200)), (22, "é" * 40 + "\x00\x1c\x7f"),
    ]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), "k", None, "s", "i", "f", "r", "b", "1", "2", "3", "4") for i, t in rows], SCHEMA)


def collect(df, key="doc_id"):
    return sorted((tuple(r.asDict().items()) for r in df.collect()), key=str)
