"""Small tables with the odd cases that every operator must take."""

import random

LONG = "lorem ipsum dolor sit amet " * 20_000

ODD_ROWS = [
    (1, "the cat sat on the mat and the dog sat by the door of the house", "en", "a", 64),
    (2, None, None, None, None),
    (3, "", "en", "", 0),
    (4, " \n\t \r\n", "xx", "a", 6),
    (5, "word", "en", "b", 4),
    (6, "the cat sat on the mat and the dog sat by the door of the house", "en", "a", 64),
    (7, LONG, "en", "b", len(LONG)),
    (8, LONG, None, "b", len(LONG)),
    (9, "a b c d", "de", "c", 7),
    (10, "A B C D", "de", "c", 7),
    (11, "ünï çödé 🤖 text with 日本語 and \x00 control", "fr", "c", 1),
    (12, "a" * 5000, "en", "c", 5000),
    (None, "no id here but words enough to count", "en", "c", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def odd_documents(spark):
    return spark.createDataFrame(ODD_ROWS, SCHEMA)


def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)


def clashing(docs, *names):
    """Extra columns with names that an operator also makes."""
    from pyspark.sql import functions as F

    return docs.withColumns({name: F.lit("mine") for name in ("extra", *names)})


def near_copies(seed: int, groups: int = 12, copies: int = 8, words: int = 120):
    """(id, text) rows: groups of copies with a few words changed, and exact copies."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7)))
    rows = []
    for _ in range(groups):
        base = [word() for _ in range(r.randint(words // 4, words))]
        for c in range(copies):
            text = base[:]
            for _ in range(r.choice([0, 0, 1, 2, 3, 5, 9])):
                text[r.randrange(len(text))] = word()
            rows.append((len(rows), " ".join(text)))
    return rows
