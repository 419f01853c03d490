import random

import pytest


def words(rng, n):
    parts = ["the", "an", "ing", "tion", "er", "ou", "st", "re", "th", "ed", "Ä", "é", "ß"]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, copies, repeated rows, and columns with clashing names."""
    rng = random.Random(9)
    base = [words(rng, rng.randrange(5, 120)) for _ in range(25)]
    edited = [" ".join(w if i != 30 else "changed" for i, w in enumerate(t.split(" "))) for t in base]
    passage = words(rng, 60)
    texts = [*base, *base[:6], *edited, base[0] + "\n" + passage, passage + " " + base[1], words(rng, 20_000), "", " \n\t", "a b c", "A  B\nC", "\x00 x", "😀 " * 60, "=" * 700, None, None]
    langs = ["en", "de", None]
    rows = [(i, t, langs[i % 3], f"src{i % 4}" if i % 9 else None, None if t is None else len(t), "x", "y") for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, base[2], None, None, None, None, None), (None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, line string, ids string").repartition(3)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


def by_id(rows):
    out = {}
    for r in rows:
        out.setdefault(r["doc_id"], []).append(r)
    return out
