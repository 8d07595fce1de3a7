"""Small documents with nulls, empty and long texts, ties, repeated rows and clashing extra columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, h long, label string, cid long, digest string"


def docs(spark, rows):
    """A documents table from (doc_id, text, lang); its extra columns clash with names that the operators use inside."""
    data = [(i, t, lang, "src", None if t is None else len(t), True, 1, "x", 5, "d") for i, t, lang in rows]
    return spark.createDataFrame(data, SCHEMA)


def prose(seed, n, words=("the", "of", "and", "house", "river", "stone", "light", "green", "walk", "never", "seven", "over", "under", "field", "glass")):
    rnd = random.Random(seed)
    return " ".join(rnd.choice(words) + rnd.choice(("", "", "s", "ing")) for _ in range(n))


def odd_rows():
    return [
        (1, None, "en"), (2, "", "en"), (3, " \t\n", None), (4, "word", "en"), (5, "Word", "en"), (6, "été 日本語 🙂", "fr"),
        (7, prose(1, 20_000), "en"), (8, "!!! 123 ???", "en"), (9, prose(2, 60), "en"), (9, prose(2, 60), "en"), (None, prose(2, 60), "en"), (-3, prose(3, 80), None),
    ]
