"""Awkward inputs and comparison helpers for the tests of this folder."""

import random

AWKWARD = [None, "", " ", "\n", "a", "A b", "x" * 3000, "word " * 4000, "é😀 ▁ \x00", "Mail bob@example.com or +1 (212) 555-0000!"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, row int, block string, component_id string, key string"


def awkward_docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows, ids used twice, columns named like inner ones."""
    rows = [(i, t, "en", f"s{i % 2}", len(t or ""), 1.0, 1, "b", "c", "k") for i, t in enumerate(AWKWARD)]
    rows += [rows[5], rows[5], (5, "another text with the same id", *rows[0][2:])]
    rows += [(None, "no id here at all", *[None] * 8), (None, None, *[None] * 8)]
    return spark.createDataFrame(rows, SCHEMA)


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df, *columns):
    """Rows as a sorted list, nulls first."""
    return sorted((tuple(r[c] for c in columns or df.columns) for r in df.collect()), key=lambda r: tuple((x is not None, str(x)) for x in r))


def near_copies(seed=3, groups=6, each=5, words=60):
    """Texts in groups of near copies, single texts, exact copies and texts that share a passage."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(2, 7)))
    shared = [word() for _ in range(25)]
    texts = []
    for _ in range(groups):
        base = [word() for _ in range(words)]
        for _ in range(each):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(words)] = word()
            texts.append(" ".join(copy))
    texts += [" ".join([word() for _ in range(10)] + shared + [word() for _ in range(30)]) for _ in range(12)]
    texts += [texts[0]] * 9 + [texts[0].upper(), "one two", "one two", "One\ttwo", "solo"]
    rng.shuffle(texts)
    return texts
